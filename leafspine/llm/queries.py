"""The registered queries opN_<name> and their SQL. Each applies its operator to the whole table and derives the
result columns from what the operator returns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprints, licenses, line_dedup, near_dedup, pii, quality, sharding, token_counts
from .common import table


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=16)
    return plan.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no", "place")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10, carry=["doc_id"])
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", "lang", F.col("__chars").alias("n_chars"), F.col("__bits").alias("bits_per_char"), F.pow(F.lit(2.0), "__bits").alias("perplexity"),
        F.col("__most").alias("most_bits"), F.col("__keep").alias("kept"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), least=0.8)
    best = F.get("__licenses", F.lit(0))
    return found.select(
        "doc_id", F.size("__licenses").cast("long").alias("n_licenses"), best["license"].alias("license"), best["dice"].alias("dice"),
        best["first_line"].alias("first_line"), best["last_line"].alias("last_line"), F.array_join(F.transform("__licenses", lambda m: m["license"]), ",").alias("licenses"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_dedup.link_documents(table(spark, sf_dir, "documents"), percent=85)
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("__spans", lambda s: s["base"])

    def of(kind: str):
        return F.size(F.filter("__spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [of(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("__spans")).alias("spans"))


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint(F.col("sketch")).alias("fingerprint"), fingerprints.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_text"), fingerprints.distinct_count(F.col("sketch")).alias("n_shingles_est"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=3, min_chars=20)
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return decoded.select("doc_id", (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"), F.sha2("__ids", 256).alias("ids_sha256"), F.sha2("__decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_shards": op1_feistel_shards,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_license_scan": op5_license_scan,
    "op6_minhash": op6_minhash,
    "op7_pii": op7_pii,
    "op8_bottom_k": op8_bottom_k,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
with dw as (select doc_id, {_WORDS} as ws from documents),
bw as (select item_id, ws, least(10, len(ws)) as n from (select item_id, {_WORDS} as ws from benchmark) where len(ws) > 0),
windows as (
  select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as w
  from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from bw)),
sizes as (select distinct n from windows),
spots as (
  select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as w
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from dw, sizes where len(ws) >= n)),
hits as (select s.doc_id, s.i, s.n, b.item_id from spots s join windows b on s.n = b.n and s.w = b.w),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids
  from (select distinct doc_id, cast(item_id as varchar) as x from hits) group by doc_id)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(i.n_items, 0) as bigint) as n_items, sha256(coalesce(i.ids, '')) as items_sha256,
  coalesce(c.n_hit, 0) > 0 as contaminated
from dw d left join covered c on d.doc_id = c.doc_id left join items i on d.doc_id = i.doc_id""",
    "op6_minhash": f"""
with recursive w as (select doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
edges as (select a, b from links union all select b, a from links),
reach as (select a as doc_id, b as r from edges union select reach.doc_id, e.b from reach join edges e on e.a = reach.r),
least_ids as (select doc_id, min(r) as r from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(l.r, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(l.r, d.doc_id)) as kept
from documents d left join n on n.doc_id = d.doc_id left join least_ids l on l.doc_id = d.doc_id""",
    "op9_line_dedup": f"""
with lines as (
  select doc_id, pos, line, trim({_LOWER.format("line")}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
  from (select doc_id, generate_subscripts(ls, 1) as pos, unnest(ls) as line
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
frequent as (select key, max(doc_id) as last from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select l.doc_id, l.pos, l.line, f.key is not null and l.doc_id <> f.last as gone
  from lines l left join frequent f on l.key = f.key)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""",
}
