"""Rules for recognised lines: confidence, type, level and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHAPTER, NUMERAL, SPACE, strip
from . import txt

_COUNT = "0-9一二三四五六七八九十"
HEADING = rf"(?i)^(第[{NUMERAL}]+[章节篇回]|(Chapter|Part)[{SPACE}]+[0-9]+|[{_COUNT}]+[、.{SPACE}]|摘要|前言|引言|结论|总结|附录)"
LIST = rf"^[•*0-9-]+[.)]?[{SPACE}]"
LEVEL1 = rf"^(第[{NUMERAL}]+[章节篇回]|(?i:Chapter)[{SPACE}]+[0-9]+)"
LEVEL2, LEVEL3 = rf"^[{_COUNT}]+[、.{SPACE}]", rf"^[（(][{_COUNT}]+[)）]"
NUMBERED_HAN = rf"^([0-9]{{1,3}}[.、{SPACE}]+|[0-9]{{2,3}}[{SPACE}]+)[\x{{4e00}}-\x{{9fa5}}]"


def recognised(results: DataFrame) -> DataFrame:
    """Lines from results (doc_id, page_num, lines: array of structs corners, text, confidence): texts with a confidence
    over 0.5, numbered through the document, with the box of corners 0 and 2."""
    from pyspark.sql import Window

    rows = results.select("doc_id", "page_num", F.posexplode("lines").alias("line_no", "l"))
    rows = rows.select("doc_id", "page_num", "line_no", F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"), F.col("l.corners").alias("c"))
    kept = confident(rows)
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "line_no")) - 1
    corner = lambda i, j: F.get(F.get("c", F.lit(i)), F.lit(j))
    return kept.select("doc_id", pos.alias("pos"), "page_num", "text", corner(0, 0).alias("x0"), corner(0, 1).alias("y0"), corner(2, 0).alias("x1"), corner(2, 1).alias("y1"))


def confident(lines: DataFrame) -> DataFrame:
    return lines.filter("text <> '' and confidence > 0.5")


def line_type(text: str | Column) -> Column:
    t = strip(text)
    return F.when((F.length(t) < 30) & t.rlike(HEADING), "heading").when(t.rlike(LIST), "list").when(t.startswith(">") | t.startswith("「"), "quote").otherwise("paragraph")


def line_level(text: str | Column) -> Column:
    t = strip(text)
    return F.when(t.rlike(LEVEL1), 1).when(t.rlike(LEVEL2), 2).when(t.rlike(LEVEL3), 3).otherwise(0)


def blocks(lines: DataFrame) -> DataFrame:
    """doc_id, pos, type, text, level of confident lines (doc_id, pos, text, confidence)."""
    return confident(lines).select("doc_id", "pos", line_type("text").alias("type"), "text", line_level("text").alias("level"))


def _boundary() -> Column:
    t = strip("text")
    return (F.col("type") == "heading") & (t.rlike(CHAPTER) | t.rlike(NUMBERED_HAN))


def chapters(blocks: DataFrame) -> DataFrame:
    return txt.chapters(blocks, is_boundary=_boundary())


def chapter_blocks(blocks: DataFrame) -> DataFrame:
    return txt.chapter_blocks(blocks, is_boundary=_boundary())
