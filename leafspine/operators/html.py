"""HTML chapters over the relation of nodes (``sources.html.nodes``): all h1 and h2 are boundaries of one rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cjk_count, latin_words, mixed_word_count, remove_first, strip
from ..plans.segment import joined, ordered, running_segment

#: The block type of each tag; other tags are paragraphs, h1 and h2 are none.
TYPES = {"heading": ["h3", "h4", "h5", "h6"], "list": ["ul", "ol"], "quote": ["blockquote"], "code": ["pre", "code"], "table": ["table"]}


def without_scripts(html: str | Column) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return F.regexp_replace(F.regexp_replace(h, r"(?is)<script.*?</script>", ""), r"(?is)<style.*?</style>", "")


def doc_title(html: str | Column) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return strip(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))


def block_type(tag: str | Column) -> Column:
    t = F.col(tag) if isinstance(tag, str) else tag
    out = F.lit("paragraph")
    for kind, tags in TYPES.items():
        out = F.when(t.isin(*tags), kind).otherwise(out)
    return F.when(~t.isin("h1", "h2", "script", "style"), out)


def style(nodes: DataFrame) -> DataFrame:
    """nodes with ``bold``, ``italic`` and ``alignment`` from the tag, the style attribute and parts of class names."""
    s, c = F.lower(F.coalesce("attr_style", F.lit(""))), F.lower(F.coalesce("attr_class", F.lit("")))
    bold = F.col("tag").isin("b", "strong") | (s.contains("font-weight") & (s.contains("bold") | s.contains("700"))) | c.contains("bold") | c.contains("strong")
    italic = F.col("tag").isin("i", "em") | (s.contains("font-style") & s.contains("italic")) | c.contains("italic") | c.contains("em")
    alignment = F.when(s.contains("text-align"), F.when(s.contains("center"), "center").when(s.contains("right"), "right").when(s.contains("left"), "left"))
    return nodes.withColumns({"bold": bold, "italic": italic, "alignment": alignment})


def title(nodes: DataFrame) -> Column:
    """A boundary's text, else its title attribute; null if both are empty."""
    return F.coalesce(F.nullif("text", F.lit("")), F.nullif(strip(F.coalesce("attr_title", F.lit(""))), F.lit("")))


def has_substance(text: str | Column, heading: str | Column) -> Column:
    """More than three CJK characters or five words beside the first occurrence of the title."""
    rest = remove_first(text, heading)
    return (cjk_count(rest) > 3) | (latin_words(rest) >= 5)


def segments(nodes: DataFrame) -> DataFrame:
    """nodes with ``seg``: the number of boundaries so far."""
    return nodes.withColumn("seg", running_segment(F.col("tag").isin("h1", "h2").cast("int")))


def chapters(nodes: DataFrame, dedup: bool = False) -> DataFrame:
    """doc_id, chapter_index (from 0), title, word_count, text of nodes of whole pages."""
    return chapter_segments(nodes, dedup).drop("seg")


def chapter_segments(nodes: DataFrame, dedup: bool = False) -> DataFrame:
    """The chapters with the segment that each is made of.

    Each element between two boundaries adds its whole text, so nested elements add theirs again; with dedup on, only
    elements whose parent lies outside the chapter do. A boundary without a title ends a chapter and starts none. A
    page without boundaries is one chapter 正文 of its body.
    """
    s = segments(nodes).withColumn("title", F.when(F.col("tag").isin("h1", "h2"), title(nodes)))
    s = s.withColumn("first", F.min("pos").over(Window.partitionBy("doc_id", "seg")))
    inside = F.col("parent") < F.col("first") if dedup else F.lit(True)
    shown = (F.col("n_strings") > 0) & inside
    made = s.filter("seg >= 1").groupBy("doc_id", "seg").agg(F.min_by("title", "pos").alias("title"), joined(F.when(shown, F.col("text")), "").alias("flat"), joined(F.when(shown, F.col("lines")), "\n").alias("text"))
    made = made.filter(F.col("title").isNotNull() & has_substance("flat", "title"))
    made = made.withColumn("word_count", mixed_word_count("text")).filter("word_count > 0")
    made = made.withColumn("chapter_index", F.row_number().over(ordered(pos="seg")) - 1).select("doc_id", "seg", "chapter_index", "title", "word_count", "text")
    headless = s.withColumn("top", F.max("seg").over(Window.partitionBy("doc_id"))).filter("top = 0 and tag = 'body'")
    body = headless.withColumn("rn", F.row_number().over(ordered())).filter("rn = 1").select("doc_id", "seg", F.lit(0).alias("chapter_index"), F.lit("正文").alias("title"), mixed_word_count("lines").alias("word_count"), F.col("lines").alias("text"))
    return made.unionByName(body.filter("word_count > 0"))


def blocks(nodes: DataFrame) -> DataFrame:
    """doc_id, pos, seg, type, text, bold, italic, alignment of the elements that hold text, boundaries left out."""
    s = style(segments(nodes)).withColumn("type", block_type("tag"))
    return s.filter("type is not null and text <> ''").select("doc_id", "pos", "seg", "type", "text", "bold", "italic", "alignment")
