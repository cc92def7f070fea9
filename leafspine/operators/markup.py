"""XML and RTF by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, col, count_of, strip

#: The elements that are chapters, in the order in which they are looked for.
TAGS = ["chapter", "section", "part", "book", "article", "title", "head", "body", "item", "entry"]
#: Fixed value: the beginning of a line that is a chapter.
RTF_CHAPTER = r"(?i)^(CHAPTER|SECTION|PART|第[一二三四五六七八九十0-9]+章)"


def without_tags(text: str | Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(col(text), r"<[^>]+>", " "), rf"[{SPACE}]+", " "))


def xml_chapters(docs: DataFrame, content_col: str = "content") -> DataFrame:
    """A chapter for each match of each tag, numbered in the order of tags and matches; empty ones use up a number.
    Documents without any are one chapter ``XML内容``."""
    content = F.regexp_replace(content_col, r"^<\?xml[^>]*\?>", "")
    found = F.concat(*[_matches(content, t) for t in TAGS])
    rows = docs.select("doc_id", content.alias("content"), F.posexplode_outer(found).alias("i", "m"))
    rows = rows.withColumn("text", without_tags("m.inner")).withColumn("any", F.max(F.coalesce(F.length("text"), F.lit(0)) > 0).over(Window.partitionBy("doc_id")))
    chapters = rows.filter(F.col("any") & (F.length("text") > 0)).select("doc_id", (F.col("i") + 1).alias("chapter_index"), F.concat("m.tag", F.lit(": "), F.substr("text", F.lit(1), F.lit(50))).alias("title"), "text")
    rest = rows.filter(~F.col("any")).dropDuplicates(["doc_id"])
    plain = strip(F.regexp_replace(F.regexp_replace("content", r"<[^>]+>", " "), rf"[{SPACE}]+", "\n"))
    whole = rest.select("doc_id", F.lit(1).alias("chapter_index"), F.lit("XML内容").alias("title"), plain.alias("text"))
    return chapters.unionByName(whole).withColumn("word_count", F.length("text").cast("long"))


def _matches(content: Column, tag: str) -> Column:
    inner = F.regexp_extract_all(content, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(inner, lambda m: F.struct(F.lit(tag.upper()).alias("tag"), m.alias("inner")))


def rtf_text(content: str | Column) -> Column:
    """The text of an RTF source on one line. The expressions, in their order."""
    t = F.regexp_replace(col(content), r"\{\\rtf1[^}]*\}", "")
    t = F.regexp_replace(t, rf"\\[a-z]+[0-9]*[{SPACE}]?", " ")
    t = F.regexp_replace(t, rf"\\\*\\[^{SPACE}{{}}]+", " ")
    parts = F.split(t, r"\\'(?=[0-9a-fA-F]{2})", -1)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.char(F.conv(F.substr(p, F.lit(1), F.lit(2)), 16, 10).cast("int")), F.substr(p, F.lit(3))))
    t = F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))
    return strip(F.regexp_replace(F.regexp_replace(t, r"[{}]", ""), rf"[{SPACE}]+", " "))


def rtf_chapters(docs: DataFrame, content_col: str = "content") -> DataFrame:
    """One chapter: named by its line, with nothing in it, if that looks like a heading, else 全文 with the line."""
    t = rtf_text(content_col)
    rows = docs.select("doc_id", t.alias("line")).withColumn("headed", F.col("line").rlike(RTF_CHAPTER))
    text = F.when(F.col("headed"), F.lit("")).otherwise(F.col("line"))
    return rows.select("doc_id", F.lit(1).alias("chapter_index"), F.when(F.col("headed"), F.col("line")).otherwise(F.lit("全文")).alias("title"), F.length(text).cast("long").alias("word_count"), F.when(F.col("headed"), F.lit(0)).otherwise(count_of("line", "\n\n") + 1).cast("long").alias("paragraph_count"))
