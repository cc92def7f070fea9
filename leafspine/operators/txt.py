"""Plain text: lines to blocks to chapters, as window folds over (doc_id, pos, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHAPTER, SPACE, strip
from ..plans.segment import earlier, in_order, joined, last_known, ordered, running_segment, upto

HEADING = rf"^(#{{1,6}})[{SPACE}]+(.+)$"
ITEM = rf"^([-*+]|[0-9]+[.)])[{SPACE}]+(.+)$"
FENCE = "```"


def split_lines(docs: DataFrame, text_col: str = "text", doc_col: str = "doc_id") -> DataFrame:
    """doc_id, pos (from 0) and line; empty lines at the end are kept."""
    return docs.select(F.col(doc_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))


def fence_state(lines: DataFrame) -> DataFrame:
    """lines with the stripped line ``s``, ``before`` and ``after``: whether code is open before and after the line.

    A bare fence toggles; a fence with anything behind it opens, and inside code it is code. So the state is 1 after
    the last opening fence, turned over by each bare fence since.
    """
    s = lines.withColumn("s", strip("line"))
    s = s.withColumns({"bare": (F.col("s") == FENCE).cast("int"), "info": (F.col("s").startswith(FENCE) & (F.col("s") != FENCE)).cast("int")})
    s = s.withColumn("n_bare", F.sum("bare").over(upto()))
    s = s.withColumns({"base": last_known(F.when(F.col("info") == 1, F.col("n_bare")), upto()), "seen": F.max("info").over(upto())})
    after = F.when(F.col("seen") == 1, (1 + F.col("n_bare") - F.col("base")) % 2).otherwise(F.col("n_bare") % 2).cast("int")
    s = s.withColumn("after", after).withColumn("before", F.coalesce(F.lag("after").over(ordered()), F.lit(0)))
    return s.drop("n_bare", "base", "seen")


def classify_lines(lines: DataFrame) -> DataFrame:
    """lines with ``cls``: O, C, Z code (opening, body, closing), B blank, H heading, L list item, Q quote, P paragraph,
    D dropped. A numbered or ``+`` item inside a paragraph belongs to the paragraph."""
    s = fence_state(lines)
    fence = (F.col("bare") == 1) | (F.col("info") == 1)
    t = F.col("s")
    first = F.left(t, F.lit(1))
    raw = (
        F.when((F.col("before") == 1) & (F.col("bare") == 1), "Z")
        .when(F.col("before") == 1, "C")
        .when(fence, "O")
        .when(t == "", "B")
        .when(t.rlike(HEADING), "H")
        .when(t.rlike(ITEM), F.when(first.isin("-", "*"), "L").otherwise("A"))
        .when(first == ">", "Q")
        .when(t.rlike(CHAPTER), "H")
        .when(first.isin("#", "-", "*"), "D")
        .otherwise("P")
    )
    s = s.withColumn("raw", raw)
    s = s.withColumn("in_para", last_known(F.when(F.col("raw") != "A", F.col("raw")), earlier()) == "P")
    return s.withColumn("cls", F.when(F.col("raw") != "A", F.col("raw")).when(F.col("in_para"), "P").otherwise("L")).drop("in_para", "raw")


def number_blocks(classified: DataFrame) -> DataFrame:
    """Lines that belong to a block, with the block's number ``blk``."""
    s = classified.withColumns({"prev": F.lag("cls").over(ordered()), "prev_full": last_known(F.when(F.col("cls") != "B", F.col("cls")), earlier())})
    starts = (
        F.when(F.col("cls").isin("O", "H"), 1)
        .when(F.col("cls").isin("L", "Q"), (~F.col("prev_full").eqNullSafe(F.col("cls"))).cast("int"))
        .when(F.col("cls") == "P", (~F.col("prev").eqNullSafe(F.col("cls"))).cast("int"))
        .otherwise(0)
    )
    return s.withColumn("blk", running_segment(starts)).filter(~F.col("cls").isin("B", "D")).drop("prev", "prev_full")


def blocks(lines: DataFrame) -> DataFrame:
    """doc_id, pos (of the first line), type, text, level, language, list_items, list_ordered."""
    s = number_blocks(classify_lines(lines))
    item, quoted = F.regexp_extract("s", ITEM, 2), strip(F.substr("s", F.lit(2), F.length("s")))
    by = F.col("cls")
    grouped = s.groupBy("doc_id", "blk").agg(
        F.min("pos").alias("pos"), F.min_by("cls", "pos").alias("kind"), F.min_by("s", "pos").alias("head"),
        joined(F.when(by == "C", F.col("line")), "\n").alias("code"), joined(F.when(by == "P", F.col("s")), " ").alias("para"),
        joined(F.when(by == "Q", quoted), "\n").alias("quote"), in_order(F.when(by == "L", item)).alias("items"),
        F.max_by(F.col("s").rlike(r"^[0-9]"), "pos").alias("ordered"),
    )
    kind = F.col("kind")
    heading = F.col("head").rlike(HEADING)
    mark = F.when(F.col("ordered"), "1. ").otherwise("- ")
    text = (
        F.when(kind == "O", F.col("code"))
        .when(kind == "P", F.col("para"))
        .when(kind == "Q", F.col("quote"))
        .when(kind == "L", F.array_join(F.transform("items", lambda x: F.concat(mark, x)), "\n"))
        .when(heading, F.regexp_extract("head", HEADING, 2))
        .otherwise(F.col("head"))
    )
    names = F.create_map(*[F.lit(x) for x in ("O", "code", "P", "paragraph", "Q", "quote", "L", "list", "H", "heading")])
    language = F.regexp_extract("head", r"^```([\p{L}\p{N}_]+)$", 1)
    return grouped.select(
        "doc_id", "pos", names[kind].alias("type"), text.alias("text"),
        F.when(kind == "H", F.when(heading, F.length(F.regexp_extract("head", HEADING, 1))).otherwise(1)).otherwise(0).cast("int").alias("level"),
        F.when((kind == "O") & (language != ""), language).alias("language"),
        F.when(kind == "L", F.col("items")).alias("list_items"), F.when(kind == "L", F.col("ordered")).alias("list_ordered"),
    )


def _titled(blocks: DataFrame, is_boundary=None) -> DataFrame:
    boundary = (F.col("type") == "heading") & ((F.col("level") == 1) | F.col("text").rlike(CHAPTER)) if is_boundary is None else is_boundary
    seg = blocks.withColumn("seg", running_segment(boundary))
    inside = Window.partitionBy("doc_id", "seg").orderBy("pos")
    return seg.withColumn("is_title", (F.row_number().over(inside) == 1) & (F.col("type") == "heading"))


def chapter_blocks(blocks: DataFrame, is_boundary=None) -> DataFrame:
    """The blocks with the index of their chapter, without those that are its title."""
    numbered = _titled(blocks, is_boundary).withColumn("chapter_index", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("seg")))
    return numbered.filter(~F.col("is_title")).drop("seg", "is_title")


def chapters(blocks: DataFrame, is_boundary=None) -> DataFrame:
    """doc_id, chapter_index, title, level, word_count, paragraph_count from blocks (doc_id, pos, type, text, level).

    A boundary starts a chapter; blocks before the first are a chapter of their own. The first block is the title if
    it is a heading and doesn't count; other chapters are named by their number.
    """
    titled = _titled(blocks, is_boundary)
    made = titled.groupBy("doc_id", "seg").agg(
        F.max(F.when(F.col("is_title"), F.col("text"))).alias("title"), F.min("pos").alias("pos"),
        F.coalesce(F.sum(F.when(~F.col("is_title"), F.length("text"))), F.lit(0)).cast("long").alias("word_count"),
        F.count_if((F.col("type") == "paragraph") & ~F.col("is_title")).alias("paragraph_count"),
    )
    made = made.withColumn("chapter_index", F.row_number().over(ordered(pos="seg")))
    return made.select("doc_id", "chapter_index", F.coalesce("title", F.concat(F.lit("章节 "), F.col("chapter_index").cast("string"))).alias("title"), F.lit(1).alias("level"), "word_count", "paragraph_count")


def doc_totals(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("doc_id").agg(F.sum("word_count").cast("long").alias("total_words"), F.count(F.lit(1)).alias("total_chapters"), F.sum("paragraph_count").cast("long").alias("total_paragraphs"))
