"""Operator 9, line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the
threshold and reassemble the rest by position. DataFrame functions only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least ``min_chars``
code points that stand in at least ``min_docs`` documents lose all their lines except those of the largest id
holding the key.

Only digests travel: a line is 16 bytes of MD5, once per document, so the counting shuffles never carry text. Counts
have partial sums before each shuffle, so a line of a third of all documents is one record per task. The positions
to drop are joined back to the documents on a digest of id and text.

Defined results: a null or empty text is one empty line and is returned as it is; a null id is a document that comes before all
others; rows that repeat an id are one document (each row keeps its own lines); repeated lines inside the kept
document all stay; an empty table gives no rows; extra columns are kept, but those named like a result of
:func:`dedup_lines` give way to it; ids are of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Positional, stored

RESULTS = ("__n_lines", "__n_dropped")
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z only; lower() does the same, faster, on texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _row_hash(text_col: str) -> Column:
    """With the id it names a row: rows that share both have equal lines and lose the same ones."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def dropped_positions(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id``, ``__hash`` (of the text) and ``__drop``, the 0-based positions of the lines to drop, for rows that
    lose any. The digests of the lines are stored once, as they are counted and then looked up again."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    split = docs.select(F.col(f"`{id_col}`").alias("__id"), _row_hash(text_col).alias("__hash"), F.split(ascii_lower(text), "\n", -1).alias("lines"))
    split = split.select("__id", "__hash", F.posexplode("lines").alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(BLANK)))
    lines = stored(split.filter(F.length("line") >= min_chars).select("__id", "__hash", "pos", F.unhex(F.md5("line")).alias("key")), "lines")
    held = lines.groupBy("key", "__id").agg(F.lit(1).alias("one"))
    counted = held.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("__id").alias("last"))
    # a plain table: both sides of the join can be split where a line is in very many documents
    frequent = stored(counted.filter(F.col("docs") >= min_docs).select("key", "last"), "frequent")
    gone = lines.join(frequent, "key").filter(~F.col("__id").eqNullSafe(F.col("last")))
    return gone.groupBy("__id", "__hash").agg(F.collect_set("pos").alias("__drop"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with the text reassembled from the lines that stay, and ``__n_lines`` and
    ``__n_dropped``."""
    p = Positional(docs)
    id_col, text_col = p.of(id_col), p.of(text_col)
    gone = dropped_positions(p.rows, min_docs, min_chars, id_col, text_col)
    keyed = p.rows.withColumn("__th", _row_hash(text_col))
    joined = keyed.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__hash")), "left")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rebuilt = joined.withColumn("__n_dropped", F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long"))
    rebuilt = rebuilt.withColumn("__n_lines", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))
    rebuilt = rebuilt.withColumn("__lines", F.when(F.col("__drop").isNotNull(), F.split(text, "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n"))
    return rebuilt.withColumn(text_col, kept).select(*p.back(RESULTS), *RESULTS)


def drop_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the lines that stay, its columns and no others; length_col: a column that holds the text's length."""
    p = Positional(docs)
    kept = dedup_lines(p.rows, min_docs, min_chars, p.of(id_col), p.of(text_col))
    if length_col is not None:
        kept = kept.withColumn(p.of(length_col), F.length(p.of(text_col)).cast("long"))
    return kept.select(*p.back())
