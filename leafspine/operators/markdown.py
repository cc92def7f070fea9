"""Markdown: lines to blocks to chapters. Only ``#`` starts a chapter; what stands before the first is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, count_of, strip
from ..plans.segment import running_segment

H1, H2 = rf"^#[{SPACE}]+(.+)$", rf"^##[{SPACE}]+(.+)$"
BULLET, NUMBER = rf"^[-*+][{SPACE}]+(.+)$", rf"^[0-9]+\.[{SPACE}]+(.+)$"


def blocks(lines: DataFrame) -> DataFrame:
    """doc_id, pos, type, text, level, list_ordered, seg (0 before the first chapter); a block a line. Fence marks are
    no blocks, what stands between them is read like other lines."""
    s = lines.withColumn("s", strip("line"))
    t = F.col("s")
    kind = (
        F.when(t == "", "blank")
        .when(t.rlike(H1), "h1")
        .when(t.rlike(H2), "h2")
        .when(t.rlike(BULLET), "bullet")
        .when(t.rlike(NUMBER), "number")
        .when(t.startswith("```"), "fence")
        .when(t.startswith(">"), "quote")
        .otherwise("paragraph")
    )
    s = s.withColumn("kind", kind)
    k = F.col("kind")
    text = F.when(k == "paragraph", t).when(k == "number", strip(F.regexp_extract("s", NUMBER, 1))).otherwise(strip(F.regexp_replace("s", r"^(##?|[-*+>])", "")))
    out = s.withColumns({
        "type": F.when(k.isin("h1", "h2"), "heading").when(k.isin("bullet", "number"), "list").otherwise(k), "level": F.when(k == "h1", 1).when(k == "h2", 2).otherwise(0),
        "text": text, "list_ordered": F.when(k.isin("bullet", "number"), k == "number"),
    })
    # blank lines and fences go behind the window: before it, the test would be pushed down and the rules run twice
    numbered = out.withColumn("seg", running_segment(F.col("level") == 1)).filter("kind not in ('blank', 'fence')")
    return numbered.select("doc_id", "pos", "type", "text", "level", "list_ordered", "seg")


def chapters(blocks: DataFrame) -> DataFrame:
    """doc_id, chapter_index, title, word_count (title included) and paragraph_count of documents that have chapters."""
    made = blocks.filter("seg >= 1").groupBy("doc_id", "seg").agg(
        F.min_by("text", "pos").alias("title"), F.sum(F.length("text")).cast("long").alias("word_count"), F.count_if(F.col("type") == "paragraph").alias("paragraph_count"))
    return made.select("doc_id", F.col("seg").cast("int").alias("chapter_index"), "title", "word_count", "paragraph_count")


def whole(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """One chapter 全文 for each document (doc_id, text) of which no line starts a chapter."""
    headed = lines.filter(strip("line").rlike(H1)).select("doc_id").distinct()
    rest = docs.join(headed, "doc_id", "left_anti")
    return rest.select("doc_id", F.lit(1).alias("chapter_index"), F.lit("全文").alias("title"), F.length("text").cast("long").alias("word_count"), (count_of("text", "\n\n") + 1).alias("paragraph_count"))
