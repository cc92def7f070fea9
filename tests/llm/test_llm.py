"""The corpus operators against brute force, on a table of odd rows: nulls, empty and long texts, copies, repeated rows
and extra columns whose names clash with what operators call their own."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from leafspine.llm import bpe, decontaminate, fingerprints, licenses, line_dedup, near_dedup, pii, quality, queries, sharding, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, pos int, line string, key string, label string, size int, band int"
BENCH = "item_id long, text string"
RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split(" "))


PASSAGE = prose(30, "bench")
COMMON = "This line stands in many documents, again and again."
ODD = [None, "", " ", "\n", "one", "two words", "ß İ ﬁ 中文 😀", "\x00\x1f\x7f\x85\xa0", "a" * 5000, " ".join(["x"] * 30_000)]
NEAR = prose(120, "near")
TEXTS = [
    *ODD, NEAR, NEAR, *[edited(NEAR, i, s) for i, s in enumerate((0.005, 0.01, 0.01, 0.02, 0.05, 0.2))], *[prose(80, i) for i in range(12)],
    f"{prose(20, 'c')} {PASSAGE} {prose(5, 'd')}", f"{prose(20, 'e')} {PASSAGE.upper()[: len(PASSAGE) // 2]} end",
    *[f"{prose(9, f'l{i}')}\n  {COMMON if i % 2 else COMMON.upper()}\t\n{prose(9, f'm{i}')}\n{COMMON}" for i in range(5)],
]


def rows_of(texts, start=0):
    return [(start + i, t, "en" if i % 3 else None, "s", None if t is None else len(t), 1, "n", 2, "l", "k", "b", 3, 4) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(TEXTS)
    return spark.createDataFrame([*rows, rows[12], rows[12], (None, "null id", "en", None, None, *rows[0][5:])], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, "two words"), (3, None), (4, "?!"), (5, PASSAGE), (10, prose(12, "other"))], BENCH)


# 1


def test_permutation():
    for n in (1, 2, 3, 10, 97, 1000, 4097):
        p = sharding.permute(np.arange(n), n, seed=3)
        assert sorted(p.tolist()) == list(range(n))
        assert sharding.permute(p, n, seed=3, forward=False).tolist() == list(range(n))
    assert sharding.row_at(*sharding.place(55, 1000, 16), 1000, 16) == 55


def test_shards(docs, none):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == docs.count() and sorted(r.row_no for r in rows) == list(range(len(rows)))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert (r.shard, r.slot) == sharding.place(r.row_no, len(rows), 4)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    again = {(r.doc_id, r.row_no) for r in sharding.shard_documents(docs.repartition(7), 4).collect()}
    assert again == {(r.doc_id, r.row_no) for r in rows}
    assert sharding.shard_documents(none, 4).count() == 0


# 2


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c >= "\x80" or c.isascii() and (c.isdigit() or "a" <= c <= "z") else " " for c in low).split(" ")


def brute_hits(text, items, n=10):
    w = [x for x in plain_words(text) if x]
    hit, found = set(), set()
    for item, t in items:
        b = [x for x in plain_words(t) if x]
        k = min(n, len(b))
        wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [64 << 20, 64])
def test_decontamination(docs, bench, limit):
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = decontaminate.scan(docs, bench, carry=["doc_id", "text"], max_chunk_bytes=limit).withColumn("n", decontaminate.n_hit()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["__n_words"], r.n, r["__items"]) == brute_hits(r.text, items), r.doc_id
    assert sum(r.n > 0 for r in rows) >= 3


def test_decontamination_modes(docs, bench, none, spark):
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and all(PASSAGE not in (r.text or "") for r in kept.collect())
    cut = decontaminate.decontaminate(docs, bench, mode="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert all(brute_hits(r.text, [(1, PASSAGE)])[1] == 0 for r in cut.collect())
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], BENCH)).count() == docs.count()
    assert decontaminate.decontaminate(none, bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, mode="x")


# 3


def brute_bits(trained, texts):
    """Interpolated modified Kneser-Ney in plain Python."""
    grams = {5: Counter()}
    for t in trained:
        c = [1] * 4 + quality.classes(t).tolist()
        grams[5].update(tuple(c[i : i + 5]) for i in range(len(c) - 4))
    for k in (4, 3, 2, 1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d = {k: quality.discounts([sum(v == i for v in grams[k].values()) for i in range(1, 5)]) for k in grams}
    contexts = {k: defaultdict(list) for k in grams}
    for k, own in grams.items():
        for g, n in own.items():
            contexts[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        below = 1 / quality.CLASSES if k == 1 else p(g[1:])
        counts = contexts[k].get(g[:-1])
        if not counts:
            return below
        disc = lambda n: d[k][min(n, 3) - 1] if n else 0
        return (grams[k].get(g, 0) - disc(grams[k].get(g, 0)) + sum(map(disc, counts)) * below) / sum(counts)

    out = []
    for t in texts:
        c = [1] * 4 + quality.classes(t).tolist()
        out.append(sum(-np.log2(p(tuple(c[i : i + 5]))) for i in range(len(t))) / len(t))
    return out


def test_language_model(spark):
    texts = [prose(60, f"q{i}") for i in range(8)] + ["!!! ??? ###", "w1 w2 中文"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    rows = docs.selectExpr("*", "case when doc_id < 6 then 1 else 0 end as __trust").repartition(2)
    got = {r.doc_id: r["__bits"] for r in quality.score(rows, quality.answers_for(rows)).collect()}
    for i, want in enumerate(brute_bits(texts[:6], texts)):
        assert got[i] == pytest.approx(want, abs=0.003), i


def test_quality(spark, docs, none):
    good, bad = [prose(60, f"g{i}") for i in range(150)], [" ".join(w.upper() + "!!" for w in prose(60, f"b{i}").split()) for i in range(20)]
    all_docs = docs.unionByName(spark.createDataFrame(rows_of([*good, *bad], 1000), SCHEMA))
    labels = spark.createDataFrame([(1000 + i, 1, 0) for i in range(150)] + [(1000, 0, 0), (None, 1, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(all_docs, labels).collect()
    assert len(rows) == all_docs.count()
    kept = {r.doc_id: r["__keep"] for r in rows}
    assert sum(kept[1000 + i] for i in range(150)) >= 145 and not any(kept[1150 + i] for i in range(20))
    assert all(kept[i] for i in range(2)) and {r["__bits"] for r in rows if not r.text} == {None}
    assert quality.classify(none, labels).count() == 0
    assert all(r["__keep"] for r in quality.classify(docs, labels.limit(0)).collect())


def test_thresholds_are_one_law(spark):
    rows, sizes = [], {"big": 400, "a": 1, "b": 6, "c": 19, "d": 20}
    for i, (lang, n) in enumerate(sizes.items()):
        rows += [(lang, 2, 2.005 + i + 0.5 * (j % 2)) for j in range(n)] + [(lang, 1, 30.0)]
    rows += [("unheld", 1, 9.0), ("untrusted", 0, 9.0)]
    got = {r["__lang"]: (r["__mid"], r["__most"]) for r in quality.thresholds(spark.createDataFrame(rows, "lang string, __trust int, __bits double")).collect()}
    assert got.keys() == sizes.keys()
    for i, (lang, n) in enumerate(sizes.items()):
        high, mid = 2.005 + i + 0.5 * (n > 1), 2.005 + i
        assert got[lang] == pytest.approx((mid, high + quality.WIDE_BITS * quality.PRIOR_DOCS / (n + quality.PRIOR_DOCS))), lang


def test_rare_languages_are_kept(spark):
    """Clean texts of a language without trusted ones, beside a language with many."""
    far = ["".join(chr(ord("а") + ord(c) % 32) if c.isalpha() else c for c in prose(60, f"r{i}")) for i in range(5)]
    texts = [*[prose(60, f"g{i}") for i in range(120)], *far, far[0]]
    rows = spark.createDataFrame([(i, t, "en" if i < 120 or i == 125 else "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r["__keep"] for r in quality.classify(rows, labels).collect()}
    assert all(kept[i] for i in range(120, 125)) and not kept[125]


# 4, 10


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_token_counts(docs, none, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    t, texts = library("word_bpe_49k.json"), {r.doc_id: r.text or "" for r in docs.collect()}
    for _ in range(2):
        rows = token_counts.count_tokens(docs, path, cache).collect()
        assert len(rows) == docs.count()
        assert all((r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(t.encode(texts[r.doc_id], add_special_tokens=False))) for r in rows)
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == stored.select("content_digest").distinct().count() < docs.count()
    assert token_counts.count_tokens(none, path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(docs, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        count = lambda x: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(x))
    else:
        count = lambda x: len(library(name).encode(x, add_special_tokens=False))
    small = docs.filter("length(text) < 400")
    texts = {r.doc_id: r.text for r in small.collect()}
    assert all(r.n_tokens == count(texts[r.doc_id]) for r in token_counts.count_tokens(small, path).collect())


CHARS = st.characters(exclude_categories=["Cs"])
PIECES = st.lists(st.one_of(st.text(CHARS, max_size=6), st.sampled_from(["the ", " and", "<|endoftext|>", "'re", "  \n", "aaaa", "<|ENDOFTEXT|>", "é", "\x1c", "tion"])), max_size=12).map("".join)
BPE = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY, WORD_LIBRARY = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
CHUNKS, WHOLE = (k(public_tokenizers.path("word_bpe_49k.json")) for k in (token_counts.ChunkCounter, token_counts.LibraryCounter))


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_bpe_is_the_library(text):
    ids = BPE.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert BPE.decode(ids) == text
    assert CHUNKS.count([text]) == WHOLE.count([text]) == WHOLE.count([" ".join(x.decode() for x in text.encode().split())])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_bpe_decodes_any_ids(ids):
    assert BPE.decode(struct.pack(f"<{len(ids)}I", *ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_documents(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(rows) == docs.count() and all(r["__decoded"] == (r.text or "") for r in rows)
    assert bpe.encode(none, path).count() == 0


# 5


def test_licenses(spark, docs, none):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for name, text in licenses.TEMPLATES.items():
        found = scanner.scan(f"{prose(40, name)}\n{text}\n{prose(40, name + 'x')}")
        best = min(found, key=lambda m: (-m["dice"], m["license"]))
        assert best["license"] == name and best["first_line"] == 1 and best["dice"] == 1.0
    assert licenses.Scanner({"a": "x y z", "b": "", "c": "solo"}, 0.8).scan("solo") == [{"license": "c", "dice": 1.0, "first_line": 0, "last_line": 0}]
    assert all(not r["__licenses"] for r in licenses.scan_licenses(docs).collect())
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(none).count() == 0
    assert all(not r["__licenses"] for r in licenses.scan_licenses(docs, {}).collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=5).map(" ".join), max_size=6))
def test_license_passages(lines):
    templates = {"t": "a b c d a b", "u": "b b"}
    got = {m["license"]: m["dice"] for m in licenses.Scanner(templates, 0.6).scan("\n".join(lines))}
    for name, text in templates.items():
        own = Counter(licenses.bigrams(licenses.words(text)))
        best = max((licenses.dice(Counter(licenses.bigrams(licenses.words(" ".join(lines[i:j])))), own) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)), default=0)
        assert got.get(name, 0) == (pytest.approx(best) if best >= 0.6 - 1e-12 else 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=7).map(" ".join), max_size=5), st.sampled_from([0.3, 0.6, 0.8]))
def test_license_passages_within_lines(lines, least):
    templates = {"t": "a b c d a b", "u": "b b", "v": "d"}
    got = {m["license"]: m for m in licenses.Scanner(templates, least).scan("\n".join(lines), within=True)}
    tokens = [(w, n) for n, line in enumerate(lines) for w in licenses.words(line)]
    for name, text in templates.items():
        own = Counter(licenses.bigrams(licenses.words(text)))
        runs = [(-licenses.dice(Counter(licenses.bigrams([w for w, _ in tokens[i:j]])), own), i, j) for i in range(len(tokens)) for j in range(i + 1, len(tokens) + 1)]
        score, i, j = min(runs, default=(0, 0, 0))
        if -score >= least - 1e-12:
            assert got[name] == {"license": name, "dice": pytest.approx(-score), "first_line": tokens[i][1], "last_line": tokens[j - 1][1]}
        else:
            assert name not in got


def test_licenses_within_lines(spark):
    """Licences that share their line with other words."""
    mit = licenses.TEMPLATES["MIT text"].replace("\n", " ")
    texts = ["This is Released under the MIT License. ok then", f"{prose(150, 'p')} {mit} {prose(150, 'q')}", f"{prose(9, 'r')}\n{prose(5, 's')} {licenses.TEMPLATES['MPL-2.0 notice'].replace('. If', '.' + chr(10) + 'If')} {prose(90, 't')}\nend"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    best = {r.doc_id: tuple(r["__licenses"][0]) for r in rows if r["__licenses"]}
    assert best == {0: ("MIT statement", 1.0, 0, 0), 1: ("MIT text", 1.0, 0, 0), 2: ("MPL-2.0 notice", 1.0, 1, 2)}


# 6


def brute_components(rows, percent, width=5):
    sets, ids = defaultdict(list), {}
    for i, t in rows:
        if i is not None:
            sets[i].append(near_dedup.shingles(near_dedup.word_list(t), width))
    ids = {i: i for i in sets}

    def root(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                ids[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies(docs, none, percent):
    rows = near_dedup.link_documents(docs, percent).collect()
    assert len(rows) == docs.count()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], percent)
    assert {r.id: r.component_id for r in rows if r.id is not None} == want
    assert [r.component_id for r in rows if r.id is None] == [None]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_shingles == len(near_dedup.shingles(near_dedup.word_list(texts[r.id]))) for r in rows)
    kept = near_dedup.deduplicate(docs, percent)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, *want.values()}
    assert near_dedup.link_documents(none).count() == 0


def test_near_copies_across_blocks(spark, monkeypatch):
    """Chains and groups whose members differ: no link is lost when buckets are dealt in small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = prose(200, "chain")
    texts = [edited(base, i, 0.012) for i in range(60)]
    for i in range(20):
        texts.append(edited(texts[-1], f"x{i}", 0.012))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5)
    got = {r.id: r.component_id for r in near_dedup.link_documents(docs, 85).collect()}
    assert got == brute_components(list(enumerate(texts)), 85)


def test_sketches():
    for n in (1, 2, 7, 50, 400):
        assert not (near_dedup.sketch(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) == near_dedup._EMPTY).any()
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64))
    for keep in (1000, 2000, 2700):
        same = (near_dedup.sketch(a) == near_dedup.sketch(a[:keep])).mean()
        assert abs(same - keep / 3000) < 0.16
    assert near_dedup.rows_per_band(85) == 5 and near_dedup.rows_per_band(80) == 4


# 7


def brute_pii(text):
    import re

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(out)]


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("a1.@+- (02595z_é"), max_size=40))
def test_base_spans(text):
    assert pii.find(text) == brute_pii(text)
    base = [s for s in pii.spans(text) if s["base"]]
    assert [(s["start"], s["kind"], s["end"]) for s in base] == brute_pii(text)


@pytest.mark.parametrize(("text", "kind", "source", "value"), [
    ("😀 mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com", "john.doe@example.com"),
    ("write jane at example dot co dot uk ok", "email", "jane at example dot co dot uk", "jane@example.co.uk"),
    ("x Аnnа@exаmple.com.", "email", "Аnnа@exаmple.com", "Anna@example.com"),
    ("bob＠mail.example.com", "email", "bob＠mail.example.com", "bob@mail.example.com"),
    ("call plus one five five five one two three four five six seven!", "phone", "plus one five five five one two three four five six seven", "+15551234567"),
    ("at 192[.]168(dot)0 dot 12 up", "ip", "192[.]168(dot)0 dot 12", "192.168.0.12"),
    ("or ann_at_example_dot_org", "email", "ann_at_example_dot_org", "ann@example.org"),
    ("to ann @ mail.example.org", "email", "ann @ mail.example.org", "ann@mail.example.org"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１", "4111 1111 1111 1111"),
    ("4111 1111​ 1111 1111", "card", "4111 1111​ 1111 1111", "4111 1111 1111 1111"),
])
def test_disguises(text, kind, source, value):
    found = [s for s in pii.spans(text) if not s["base"]]
    assert [(s["kind"], text[s["start"] : s["end"]], s["value"]) for s in found] == [(kind, source, value)]
    assert pii.redact(text, found) == text.replace(source, f"[{kind}]")


@pytest.mark.parametrize(("text", "kind", "source", "value"), [
    ("to jane at example d\u043et com now", "email", "jane at example d\u043et com", "jane@example.com"),
    ("to jane at example d\u200bot com now", "email", "jane at example d\u200bot com", "jane@example.com"),
    ("to jane at example \uff44\uff4f\uff54 com now", "email", "jane at example \uff44\uff4f\uff54 com", "jane@example.com"),
    ("to ann\t@\tmail.example.org", "email", "ann\t@\tmail.example.org", "ann@mail.example.org"),
    ("call PLUS FIVE FIVE Five fiVe one two three four five!", "phone", "PLUS FIVE FIVE Five fiVe one two three four five", "+555512345"),
    ("ring F\u00dcNF SECHS", None, None, None),
    ("call +1 555 123 four 567 now", "phone", "+1 555 123 four 567", "+1 555 123 4 567"),
    ("call +1 (five five five) 123 4567 now", "phone", "+1 (five five five) 123 4567", "+1 (555) 123 4567"),
    ("call plus 1 555 123 4567 now", "phone", "plus 1 555 123 4567", "+1 555 123 4567"),
    ("call +one 555 1234 567 now", "phone", "+one 555 1234 567", "+15551234567"),
    ("at 192.168.zero.12 up", "ip", "192.168.zero.12", "192.168.0.12"),
    ("pay 4111 1111 1111 11 one one", "card", "4111 1111 1111 11 one one", "4111 1111 1111 11 11"),
])
def test_disguises_at_the_gates(text, kind, source, value):
    found = [(s["kind"], text[s["start"] : s["end"]], s["value"]) for s in pii.spans(text) if not s["base"]]
    assert found == ([(kind, source, value)] if kind else [])


@pytest.mark.parametrize("text", ["one (two) 5 six", "a plus one, plus 2", "at 192.168.0.1 one of", "one " * 30_000, "(one) " * 30_000, "plus " * 30_000, "1 one " * 30_000])
def test_short_runs_stay_small(text):
    assert [s for s in pii.spans(text) if not s["base"]] == []


@pytest.mark.parametrize("text", ["look at example.com", "he is at home. dot com", "un deux trois", "one two, three", "l'état au point de vue", "(dot) and [at]"])
def test_clean_texts_stay(text):
    assert pii.spans(text) == []


def test_pii_documents(docs, none):
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == docs.count() and all(r["__spans"] == [] for r in rows)
    assert pii.find_personal_data(none).count() == 0
    assert pii.spans("1" * 200_000) == [] and pii.spans("a" * 200_000) == [] and pii.spans("@" * 100_000) == []


# 8


def spark_hash(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w, seed=h)
    return h


def brute_sketch(text, k, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    own = [struct.pack("<Q", spark_hash([w])) for w in words]
    grams = [own[i : i + width] for i in range(len(own) - width + 1)] if len(own) >= width else [own] if own else []
    signed = {h - 2**64 if h >= 2**63 else h for h in map(spark_hash, grams)}
    return sorted(signed)[:k]


def test_fingerprints(docs, none):
    rows = fingerprints.fingerprint_documents(docs, k=16).collect()
    assert len(rows) == docs.count()
    order = sorted(docs.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id, reverse=True)
    texts = [r.text or "" for r in order]
    following = {r.doc_id: texts[(i + 1) % len(texts)] for i, r in enumerate(order)}
    seen = Counter()
    for r in rows:
        assert r.sketch == brute_sketch(r.text, 16, 5)
        half = len(r.text) // 2
        want = r.text[: len(r.text) - half] + following[r.doc_id][:half]
        if r.doc_id != order[[x.doc_id for x in order].index(12)].doc_id:  # repeated rows follow each other
            assert r.edited == want and r.edited_sketch == brute_sketch(want, 16, 5), r.doc_id
        seen[r.doc_id] += 1
    assert seen[12] == 3
    assert fingerprints.fingerprint_documents(none).count() == 0
    alone = docs.filter("doc_id = 20")
    assert alone.count() == 1 and fingerprints.fingerprint_documents(alone).first().edited[-5:] == fingerprints.fingerprint_documents(alone).first().text[: len(alone.first().text) // 2][-5:]


def test_sketch_estimates(spark):
    from pyspark.sql import functions as F

    a, b = prose(4000, "a"), prose(4000, "b")
    df = spark.createDataFrame([(a, a + " " + b, "", " \t")], "a string, b string, e string, f string")
    for c in "abef":
        df = fingerprints.with_sketch(df, c, f"s{c}", 256)
    sa, sb, se, sf = (F.col(f"s{c}") for c in "abef")
    row = df.select(fingerprints.resemblance(sa, sb, 256), fingerprints.containment(sa, sb, 256), fingerprints.distinct_count(sb, 256), fingerprints.resemblance(se, sf, 256), fingerprints.resemblance(sa, se, 256), fingerprints.merge(sa, sb, 256) == sb).first()
    assert abs(row[0] - 0.5) < 0.1 and row[1] > 0.85 and abs(row[2] - 8000) < 1500 and row[3:6] == (1.0, 0.0, True)


# 9


def brute_lines(rows, least=3, chars=20):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(-1 if i is None else i)
    gone = {k: max(s) for k, s in held.items() if len(k) >= chars and len(s) >= least}
    return [(i, t, [n for n, line in enumerate((t or "").split("\n")) if key(line) in gone and gone[key(line)] != (-1 if i is None else i)]) for i, t in rows]


def test_lines(docs, none):
    rows = line_dedup.dedup_lines(docs).collect()
    want = Counter()
    for i, t, gone in brute_lines([(r.doc_id, r.text) for r in docs.collect()]):
        lines = (t or "").split("\n")
        kept = "\n".join(x for n, x in enumerate(lines) if n not in gone) if gone else t
        want[i, kept, len(lines), len(gone)] += 1
    assert Counter((r.doc_id, r.text, r["__n_lines"], r["__n_dropped"]) for r in rows) == want
    assert sum(r["__n_dropped"] for r in rows) >= 8
    assert line_dedup.dedup_lines(docs).columns[: len(docs.columns)] == docs.columns and line_dedup.dedup_lines(none).count() == 0


# queries and pipeline


@pytest.fixture(scope="module")
def folder(spark, docs, bench, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10, len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_every_row(spark, folder, name):
    rows = queries.QUERIES[name](spark, folder).collect()
    assert len(rows) == len(TEXTS) + 3


def test_digests(spark, folder, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op10_bpe(spark, folder).collect():
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in queries.op7_pii(spark, folder).collect():
        assert r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == ""
    for r in queries.op9_line_dedup(spark, folder).collect():
        assert r.n_dropped or r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline(spark, folder, none):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
    d = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, folder)
        if name == "bpe":
            assert out.count() == d.count() and all(r.round_trip for r in out.collect())
        else:
            assert out.columns == d.columns and out.dtypes == d.dtypes and 0 < out.count() <= d.count()
            assert stage(spark, none, folder).count() == 0
            d = out.cache()
    kept = {r.doc_id: r.text for r in d.collect()}
    assert all(PASSAGE not in (t or "") for t in kept.values())
    assert sum((t or "").lower().count(COMMON.lower()) for t in kept.values()) == 2
    assert all(i == c for i, c in brute_components(list(kept.items()), 80).items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(kept)
