"""Word paragraphs: style, size statistics, classification and chapters, from (doc_id, pos, text, style_name, font_size,
is_bold, is_centered). Runs become paragraphs in :func:`paragraphs_from_runs`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUMERAL, SPACE, strip
from ..plans.segment import joined, ordered, running_segment

CHAPTER = rf"(?i)^(第[{NUMERAL}]+[章节篇回]|(Chapter|Part|Section)[{SPACE}]+[0-9]+)"
HAN = r"[\x{4e00}-\x{9fa5}]"
NUMBERED = rf"^([0-9]{{1,3}}[.、{SPACE}]|[0-9]{{2,3}}[{SPACE}]|[（(][0-9]{{1,3}}[)）]|{HAN}{{1,3}}[、.{SPACE}]|[（(]{HAN}{{1,3}}[)）])"


def paragraphs_from_runs(runs: DataFrame) -> DataFrame:
    """Paragraphs from runs (doc_id, pos, run_no, text, size, bold, italic, font, style_name, alignment): joined and
    stripped text, bold or italic if any run is, mean size, last font; empty paragraphs are left out."""
    made = runs.groupBy("doc_id", "pos").agg(
        strip(joined(F.col("text"), "", "run_no")).alias("text"), F.avg("size").alias("font_size"), F.max(F.coalesce("bold", F.lit(False))).alias("is_bold"), F.max(F.coalesce("italic", F.lit(False))).alias("is_italic"),
        F.max_by("font", F.when(F.col("font").isNotNull(), F.col("run_no"))).alias("font_name"), F.first("style_name").alias("style_name"), F.coalesce(F.first("alignment"), F.lit("left")).alias("alignment"),
    )
    return made.filter("text <> ''").withColumn("is_centered", F.col("alignment") == "center")


def style_level(style_name: str | Column) -> Column:
    """The number in the name of a heading style, 1 without one, 0 for other styles."""
    name = F.lower(F.coalesce(F.col(style_name) if isinstance(style_name, str) else style_name, F.lit("normal")))
    number = F.regexp_extract(name, r"([0-9]+)", 1)
    return F.when(name.contains("heading") | name.contains("标题"), F.when(number != "", number.cast("int")).otherwise(1)).otherwise(0)


def font_stats(paras: DataFrame) -> DataFrame:
    """Order statistics of the sizes of each document: by index n//2, n//4 and 3n//4, no interpolation; 12 and 14 as
    median and third quartile where no size is known."""
    sized = paras.filter("font_size is not null and font_size <> 0")
    by = Window.partitionBy("doc_id")
    s = sized.select("doc_id", "font_size", (F.row_number().over(by.orderBy("font_size", "pos")) - 1).alias("i"), F.count(F.lit(1)).over(by).alias("n"))

    def at(k: str) -> Column:
        return F.max(F.when(F.col("i") == F.expr(k), F.col("font_size")))

    stats = s.groupBy("doc_id").agg(F.min("font_size").alias("min_size"), F.max("font_size").alias("max_size"), F.avg("font_size").alias("mean_size"), at("n div 4").alias("q1_size"), at("n div 2").alias("median_size"), at("3 * n div 4").alias("q3_size"))
    out = paras.select("doc_id").distinct().join(stats, "doc_id", "left")
    return out.withColumns({"median_size": F.coalesce("median_size", F.lit(12.0)), "q3_size": F.coalesce("q3_size", F.lit(14.0))})


def classify(paras: DataFrame) -> DataFrame:
    """paras with ``style_level``, ``is_chapter_title`` and ``subheading_level`` (0 for none)."""
    s = paras.join(font_stats(paras).select("doc_id", "median_size", "q3_size"), "doc_id").withColumn("style_level", style_level("style_name"))
    size, n, level = F.coalesce(F.nullif("font_size", F.lit(0.0)), F.col("median_size")), F.length("text"), F.col("style_level")
    chapter = (
        F.when(level.isin(1, 2), True)
        .when((size > F.col("q3_size") * 1.15) & (n < 50), F.col("is_centered") | F.col("is_bold"))
        .when(F.col("text").rlike(CHAPTER) & (n < 60), (level > 0) | (size > F.col("median_size") * 1.1))
        .otherwise(False)
    )
    sub = (
        F.when(level >= 3, level)
        .when(F.col("text").rlike(NUMBERED), F.when((size >= F.col("median_size") * 1.05) & (size <= F.col("median_size") * 1.3), 2).otherwise(0))
        .when(F.col("is_bold") & (n < 40), 3)
        .otherwise(0)
    )
    s = s.withColumn("is_chapter_title", chapter)
    return s.withColumn("subheading_level", F.when(F.col("is_chapter_title"), 0).otherwise(sub))


def _segmented(classified: DataFrame) -> DataFrame:
    s = classified.withColumn("seg", running_segment(F.col("is_chapter_title")))
    s = s.withColumn("any", F.max("seg").over(Window.partitionBy("doc_id")) > 0).filter("not any or seg >= 1")
    inside = Window.partitionBy("doc_id", "seg")
    s = s.withColumns({"rn": F.row_number().over(inside.orderBy("pos")), "size": F.count(F.lit(1)).over(inside)})
    return s.withColumn("content", (F.col("rn") > 1) | (F.col("size") == 1))


def chapter_blocks(classified: DataFrame) -> DataFrame:
    """doc_id, chapter_index, pos, type, text, level of what chapters hold."""
    s = _segmented(classified).withColumn("chapter_index", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("seg")))
    return s.filter("content").select("doc_id", "chapter_index", "pos", F.when(F.col("subheading_level") > 0, "heading").otherwise("paragraph").alias("type"), "text", F.col("subheading_level").alias("level"))


def chapters(classified: DataFrame) -> DataFrame:
    """doc_id, chapter_index, title, word_count, paragraph_count; what stands before the first chapter is dropped, a
    document without one is a chapter named by its first paragraph. The first paragraph isn't content unless alone."""
    s = _segmented(classified)
    made = s.groupBy("doc_id", "seg").agg(
        F.substr(F.min_by("text", "pos"), F.lit(1), F.when(F.max("any"), 100).otherwise(50)).alias("title"), F.coalesce(F.sum(F.when(F.col("content"), F.length("text"))), F.lit(0)).cast("long").alias("word_count"),
        F.count_if(F.col("content") & (F.col("subheading_level") == 0)).alias("paragraph_count"),
    )
    return made.withColumn("chapter_index", F.row_number().over(ordered(pos="seg"))).select("doc_id", "chapter_index", "title", "word_count", "paragraph_count")


def doc_words(paras: DataFrame) -> DataFrame:
    """All paragraphs count, titles and preamble included."""
    return paras.groupBy("doc_id").agg(F.sum(F.length("text")).cast("long").alias("total_words"))
