"""Operator 8, document fingerprints: the bottom-k sketch of a document's shingle hashes. DataFrame functions only.

A sketch is the k smallest distinct 64-bit hashes of the shingles, ascending. The sketch of a union is the bottom k
of the sketches' union (:func:`merge`), so sketches of parts merge into that of the whole. From sketches alone
follow estimates of resemblance, containment and the number of distinct shingles.

Shingles are ``width`` consecutive words (A-Z lower-cased, cut at ``[\\x20\\x09-\\x0D]``); a text of fewer words, but
not none, is one shingle.

Defined results: a null or empty text, or one without words, has the empty sketch (fingerprint ''); two empty
sketches resemble each other fully, an empty and another one not at all; equal texts have equal sketches; repeated
rows each get their row; ids that are no integers are ordered as strings; null ids come after all others; extra columns
are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from .line_dedup import BLANK, ascii_lower

K, WIDTH = 64, 5
#: Text in a range of ids that is sorted as one, and the most ranges.
BUCKET_BYTES, MAX_CUTS = 512 << 10, 20_000
#: 2**64, the number of hashes, and the least of them.
SPAN, LEAST = float(2**64), float(-(2**63))


def with_sketch(df: DataFrame, text_col: str, sketch_col: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """df with the sketch of a text column. The word hashes are a column of their own, so that each is made once."""
    clean = F.btrim(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), F.lit(BLANK))
    out = df.withColumn("__words", F.transform(F.split(clean, r"[ \t\n\x0B\f\r]+", -1), lambda w: F.xxhash64(w)))
    out = out.withColumn("__words", F.when(F.length(clean) > 0, F.col("__words")).otherwise(F.array().cast("array<bigint>")))
    words = F.col("__words")
    shingles = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    whole = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(words)))
    out = out.withColumn("__shingles", F.when(F.size(words) >= width, shingles).otherwise(whole))
    return out.withColumn(sketch_col, bottom(F.col("__shingles"), k)).drop("__words", "__shingles")


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketch: Column, k: int = K) -> Column:
    """An aggregate: the sketch of the union of all parts of a group of bounded size."""
    return F.aggregate(F.collect_list(sketch), F.array().cast("array<bigint>"), lambda acc, s: merge(acc, s, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A or B|: the share of the union's sketch that stands in both."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below k."""
    kth = (F.element_at(a, -1).cast("double") - F.lit(LEAST)) / F.lit(SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A|."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def fingerprint(sketch: Column) -> Column:
    """A string of 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def cut_points(ids: DataFrame, parts: int) -> list:
    """Ascending values of the column ``sid`` that cut its rows into about as many parts of equal size. Only these values,
    MAX_CUTS at most, reach the driver; the order that rests on them is exact whatever they are."""
    if parts <= 1:
        return []
    if isinstance(ids.schema["sid"].dataType, LongType):
        found = ids.agg(F.percentile_approx("sid", [k / parts for k in range(1, parts)], 20 * parts).alias("p")).first()["p"] or []
    else:  # no quantiles of strings: the least of each of the ranges that a sort would deal
        ranged = ids.filter("sid is not null").repartitionByRange(min(parts, 512), "sid")
        found = [r["least"] for r in ranged.groupBy(F.spark_partition_id().alias("range")).agg(F.min("sid").alias("least")).collect()]
    return sorted(set(found))


def bucket_of(value: Column, cuts: list, kind: str) -> Column:
    """How many of the ascending cuts are at most value, by halving: a look for each bit of their number."""
    if not cuts:
        return F.lit(0)
    bounds = F.from_json(F.lit(json.dumps(cuts)), f"array<{kind}>")
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(bounds, low + step - 1) <= value, low + step).otherwise(low))


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of docs with a bucket: a range of ids with about bucket_bytes of text. In each bucket the first row of the
    range below stands as a guest, and in the lowest that of the highest.

    Columns ``sid``, ``h`` (hash of the text), ``bucket`` and ``guest`` are added. Cut points and first rows are found
    from ids and hashes alone; texts meet in :func:`with_next`.
    """
    kind = "bigint" if isinstance(docs.select(F.col(f"`{id_col}`")).schema[0].dataType, IntegralType) else "string"
    order = docs.withColumns({"sid": F.col(f"`{id_col}`").cast(kind), "h": F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))})
    size = F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)) + F.lit(16)
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    cuts = cut_points(order.select("sid"), min(total // bucket_bytes + 1, MAX_CUTS))
    order = order.withColumn("bucket", F.when(F.col("sid").isNull(), F.lit(-1)).otherwise(bucket_of(F.col("sid"), cuts, kind)))
    tops = order.groupBy("bucket").agg(F.max(F.struct("sid", "h")).alias("top"))
    above = Window.orderBy("bucket")  # a row a bucket
    lowest = F.min("bucket").over(above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select(F.col("bucket").alias("top_of"), F.col("top.sid").alias("top_sid"), F.col("top.h").alias("top_h"), F.coalesce(F.lead("bucket").over(above), lowest).alias("to"))
    is_top = (F.col("bucket") == F.col("top_of")) & F.col("sid").eqNullSafe(F.col("top_sid")) & (F.col("h") == F.col("top_h"))
    own, as_guest = F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    places = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, as_guest))
    placed = order.join(F.broadcast(tops), is_top, "left").withColumn("place", F.explode(places))
    return placed.select(*docs.columns, "sid", "h", "place.bucket", "place.guest")


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of :func:`dealt` without the guests, with ``next_<c>`` for each of columns: the value in the next row by
    descending id (equal ids: descending hash of the text), and after the last row that of the first."""
    inside = Window.partitionBy("bucket").orderBy("guest", F.desc("sid"), F.desc("h"))
    led = rows.withColumns({f"next_{c}": F.lead(f"`{c}`").over(inside) for c in columns})
    return led.filter(F.col("guest") == 0).drop("sid", "h", "bucket", "guest")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """For every row: id, text, sketch, and of its edited text (the last half of the code points replaced by the
    first as many of the next document): edited and edited_sketch, with next_sketch."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    led = with_next(with_sketch(dealt(own, bucket_bytes=bucket_bytes), "text", "sketch", k, width), ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    return with_sketch(led.withColumn("edited", edited).drop("next_text"), "edited", "edited_sketch", k, width)
