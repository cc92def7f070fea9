"""Columns named like the operators' own, ids of other types and ranges, and the values of queries that SQL can't express."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import pytest
from test_llm import LIBRARY, NEAR, PASSAGE, TEXTS, brute_components, brute_lines, brute_pii, brute_sketch, edited, prose

import corpus_pipeline
from leafspine.llm import bpe, decontaminate, fingerprints, licenses, line_dedup, near_dedup, pii, quality, queries, sharding, token_counts

#: What operators call columns of their own, on the way or as results.
OWN = [
    "__id", "__hash", "__drop", "__th", "__lines", "__n_lines", "__n_dropped", "__n_words", "__hit_runs", "__items", "__trust", "__good", "__bits", "__chars", "__most", "__mid", "__lang",
    "__key", "__keep", "__gone", "gone", "__spans", "__licenses", "__ids", "__decoded", "c0", "c1", "c9", "n_words", "runs", "items", "sid", "h", "bucket", "guest", "to", "top", "cell", "node",
    "label", "component_id", "content_digest", "sketch", "next_text", "edited", "row_no", "place",
]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en", *[f"own {i}"] * len(OWN)) for i, t in enumerate([*TEXTS, None, NEAR])]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", *[f"`{c}` string" for c in OWN]])).repartition(3)


@pytest.fixture(scope="module")
def tables(spark, clashing, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("clashing"))
    clashing.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10, len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def unharmed(rows):
    return all(r[c] == f"own {r.doc_id}" for r in rows for c in OWN if c in r.asDict())


def test_annotations_replace_columns_of_their_names(clashing, tables, spark):
    bench, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("benchmark", "labels"))
    vocabulary = queries.public_tokenizers.path("byte_bpe_50k.json")
    made = {
        ("__n_lines", "__n_dropped"): line_dedup.dedup_lines(clashing),
        ("__n_words", "__hit_runs", "__items"): decontaminate.scan(clashing, bench, carry=clashing.columns),
        quality.RESULTS: quality.classify(clashing, labels),
        ("__spans",): pii.find_personal_data(clashing),
        ("__licenses",): licenses.scan_licenses(clashing),
        ("__ids", "__decoded"): bpe.round_trip(clashing, vocabulary),
    }
    for results, out in made.items():
        rows = out.collect()
        assert len(rows) == clashing.count() and Counter(out.columns) == Counter(set(clashing.columns) | set(results))
        assert all(r[c] == f"own {r.doc_id}" for r in rows for c in OWN if c not in results) and not any(str(r[c]).startswith("own") for r in rows for c in results)


def test_filters_keep_columns_of_any_name(clashing, tables, spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, tables)
        rows = out.collect()
        assert rows and (name == "bpe" or (out.columns == clashing.columns and unharmed(rows))), name
    spans = decontaminate.decontaminate(clashing, spark.read.parquet(f"{tables}/benchmark.parquet"), mode="spans")
    assert spans.columns == clashing.columns and unharmed(spans.collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_clashing_columns(spark, tables, clashing, name):
    assert queries.QUERIES[name](spark, tables).count() == clashing.count()


def test_string_ids(spark, clashing):
    named = clashing.selectExpr("concat('doc ', lpad(cast(doc_id as string), 3, '0')) as doc_id", "text")
    got = {r.id: r.component_id for r in near_dedup.link_documents(named, 80).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in named.collect()], 80)
    assert near_dedup.deduplicate(named, 80).count() == len(set(got.values()))
    rows = fingerprints.fingerprint_documents(named, k=16, bucket_bytes=300).collect()
    check_next(rows, {r.doc_id: r.text or "" for r in named.collect()})
    assert line_dedup.dedup_lines(named).count() == sharding.shard_documents(named, 4).count() == clashing.count()
    labels = spark.createDataFrame([(f"doc {i:03}", 1, 0) for i in range(10, 30)], "doc_id string, quality int, toxic int")
    assert quality.classify(named.withColumn("lang", named.text), labels).filter("__trust > 0").count() == 20
    assert quality.classify(clashing, labels).filter("__trust > 0").count() == 0


def check_next(rows, texts):
    order = sorted(texts, reverse=True)
    after = {d: texts[order[(i + 1) % len(order)]] for i, d in enumerate(order)}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        half = len(texts[r.doc_id]) // 2
        want = texts[r.doc_id][: len(texts[r.doc_id]) - half] + after[r.doc_id][:half]
        assert r.edited == want and r.sketch == brute_sketch(texts[r.doc_id], 16, 5) and r.next_sketch == brute_sketch(after[r.doc_id], 16, 5), r.doc_id


@pytest.mark.parametrize("bytes_", [100, 2000, 1 << 20])
def test_next_documents_of_wide_ids(spark, bytes_):
    r = random.Random(bytes_)
    ids = [-(2**63), 2**63 - 1, 0, *range(100, 160), *[r.randrange(-(2**62), 2**62) for _ in range(40)]]
    texts = {i: prose(r.randrange(30), i) for i in ids}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    check_next(fingerprints.fingerprint_documents(docs, k=16, bucket_bytes=bytes_).collect(), texts)


def test_many_buckets_are_cut(spark):
    docs = spark.createDataFrame([(i, prose(20, i)) for i in range(300)] + [(2**62, "far away")], "doc_id long, text string")
    by = Counter(r.bucket for r in fingerprints.dealt(docs, bucket_bytes=2000).filter("guest = 0").collect())
    assert len(by) > 10 and max(by.values()) < 60


def test_large_bucket_without_links(spark, monkeypatch):
    """Texts that share a third of their shingles meet in buckets and aren't linked, but for some pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = prose(60, "hot")
    texts = [f"{base} {prose(25, f'h{i}')}" for i in range(40)]
    texts += [edited(t, f"e{i}", 0.004) for i, t in enumerate(texts[::4])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.component_id for r in near_dedup.link_documents(docs, 80).collect()} == brute_components(list(enumerate(texts)), 80)


def test_benchmark_in_many_chunks(spark):
    items = [(i, prose(14, f"item{i}")) for i in range(30)]
    docs = [(i, f"{prose(10, f'a{i}')} {items[i % 30][1] if i % 2 else ''} {prose(10, f'b{i}')}") for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({(r.doc_id, r["__n_words"], *r["__hit_runs"], *r["__items"]) for r in decontaminate.scan(d, b, max_chunk_bytes=n).collect()} for n in (1 << 20, 400))
    assert one == many and sum(len(x) > 2 for x in one) == 20


def test_bytes_of_a_chunk(spark):
    """A chunk takes a worker a few times its text."""
    import pickle

    text = [(i, prose(200, f"c{i}")) for i in range(2000)]
    assert len(pickle.dumps(decontaminate.Windows(text, 10))) < 5 * sum(len(t) for _, t in text)


def test_memory_of_bpe_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 50)
    own = bpe.Bpe(queries.public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    for i in range(60):
        text = " ".join("".join(r.choice("abcdefghijk ß中") for _ in range(r.randrange(1, 12))) for _ in range(30))
        ids = own.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY.encode(text, add_special_tokens=False).ids and own.decode(ids) == text
        assert len(own.young) + len(own.old) <= 2 * 20_000 // bpe.ENTRY_BYTES + 2 and len(own.pairs) <= 50


def test_scripts_have_classes_of_their_own():
    greek, han = ({int(c) for c in quality.classes("".join(map(chr, r)))} for r in (range(0x370, 0x400), range(0x4E00, 0xA000)))
    assert len(greek) == 144 and not greek & han and len(han) > 1700


def test_values_of_queries(spark, tables):
    texts = {i: t or "" for i, t in enumerate([*TEXTS, None, NEAR])}
    rows = {r.doc_id: r for r in queries.op8_bottom_k(spark, tables).collect()}
    order = sorted(texts, reverse=True)

    def near(a, b):
        union = sorted(set(a) | set(b))[: fingerprints.K]
        return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0

    for i, d in enumerate(order):
        r, after, half = rows[d], texts[order[(i + 1) % len(order)]], len(texts[d]) // 2
        changed = texts[d][: len(texts[d]) - half] + after[:half]
        own, new, other = (brute_sketch(t, fingerprints.K, 5) for t in (texts[d], changed, after))
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and r.n_chars == len(texts[d])
        assert r.fingerprint == "".join(f"{h % 2**64:016X}" for h in own) and r.edited_fingerprint == "".join(f"{h % 2**64:016X}" for h in new)
        assert r.near_edited == pytest.approx(near(own, new)) and r.near_next == pytest.approx(near(own, other))
    shards = queries.op1_feistel_shards(spark, tables).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in shards} == {(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    assert all((r.shard, r.slot) == sharding.place(r.row_no, len(texts), 16) for r in shards)
    counts = {r.doc_id: r.n_dropped for r in queries.op9_line_dedup(spark, tables).collect()}
    assert counts == {i: len(gone) for i, _, gone in brute_lines(list(texts.items()))}


def test_digests_of_personal_data(spark, tmp_path):
    texts = ["mail a.b@c.de or +49 30 1234567, 10.0.0.255", "4111 1111 1111 1111 and jane at example dot com", "10.0.0.256", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op7_pii(spark, str(tmp_path)).collect():
        want = sorted(brute_pii(texts[r.doc_id] or ""), key=lambda s: (s[0], pii.KINDS.index(s[1])))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, k, _ in want) for kind in pii.KINDS)
    assert any("email:24" in r.spans for r in queries.op7_pii(spark, str(tmp_path)).collect() if r.doc_id == 1)


def test_licences_of_documents(spark, tmp_path):
    texts = ["x\nReleased under the MIT License.\ny", f"a b {licenses.TEMPLATES['ISC text']}", "no licence here", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_licenses, r.license, r.dice, r.first_line, r.last_line) for r in queries.op5_license_scan(spark, str(tmp_path)).collect()}
    assert got[0] == (1, "MIT statement", 1.0, 1, 1) and got[1][:3] == (1, "ISC text", 1.0) and got[2][0] == got[3][0] == 0


def test_stored_counts_are_used(spark, clashing, tmp_path):
    path, cache = queries.public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    half = clashing.filter("doc_id < 20")
    token_counts.count_tokens(half, path, cache).collect()
    spark.read.parquet(cache).selectExpr("content_digest", "tokenizer_digest", "n_tokens + 1000 as n_tokens").write.parquet(f"{cache}-marked")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(clashing, path, f"{cache}-marked").collect()}
    plain = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(clashing, path).collect()}
    known = {r.text or "" for r in half.collect()}
    assert all(got[r.doc_id] - plain[r.doc_id] == 1000 * ((r.text or "") in known or plain[r.doc_id] == 0) for r in clashing.collect())


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_marked_digests_change_no_count(spark, clashing, monkeypatch, bits):
    """Lone misses are encoded where they are, all others once, also where every bit is set."""
    path, plain = queries.public_tokenizers.path("word_bpe_49k.json"), None
    tokenizer = token_counts.LibraryCounter(path)
    monkeypatch.setattr(token_counts, "BITMAP_BITS", bits)
    if bits == 1 << 15:
        plain = token_counts.bitmap
        monkeypatch.setattr(token_counts, "bitmap", lambda marked: plain(marked) | 255)
    rows = token_counts.count_tokens(clashing, path).collect()
    texts = {r.doc_id: r.text or "" for r in clashing.collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == {d: tokenizer.count([t])[0] for d, t in texts.items()} and len(rows) == len(texts)


def test_bitmap(spark):
    marks = [0, 7, 8, 32767, 32768, 99_999, 99_999]
    made = token_counts.bitmap(spark.createDataFrame([(m,) for m in marks], "bit long"))
    assert {i for i in range(200_000) if made[i >> 3] >> (i & 7) & 1} == set(marks)
