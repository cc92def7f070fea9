"""Prompt files from chapter files: body, outline, preview, title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, cjk_count, strip

OUTLINE, PREVIEW = 15, 8000
#: Fixed value: the name of a prompt file.
FILE_NAME = "AI分析提示词.md"
CUT = f"\n\n...[内容过长，已截取前{PREVIEW}字符]"


def _is_chapter(folder: Column, file_name: Column) -> Column:
    return folder.rlike("^[0-9]+_") & file_name.endswith(".md") & ~file_name.startswith("0") & ~file_name.startswith("AI")


def chapter_files(files: DataFrame) -> DataFrame:
    """The file of each numbered folder (folder, file_name): the first by name that is Markdown and starts with neither
    0 nor AI; folders in the order of number and name."""
    ok = _is_chapter(F.col("folder"), F.col("file_name"))
    return files.filter(ok).groupBy("folder").agg(F.min("file_name").alias("file_name")).withColumn("number", F.regexp_extract("folder", r"^([0-9]+)_", 1).cast("int"))


def body(content: str | Column) -> Column:
    """The third part between ``---``, stripped; the whole content if there are fewer."""
    c = F.col(content) if isinstance(content, str) else content
    parts = F.split(c, "---", -1)
    return F.when(F.size(parts) >= 3, strip(F.get(parts, F.lit(2)))).otherwise(c)


def headers(files: DataFrame, text_col: str = "body", key: str = "folder") -> DataFrame:
    """key, i (from 0), level, title of the ATX headers of each text."""
    lines = files.select(key, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    pattern = rf"^(#{{1,6}})[{SPACE}]+(.+)$"
    found = lines.filter(F.col("line").rlike(pattern)).select(key, "pos", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), F.regexp_extract("line", pattern, 2).alias("title"))
    return found.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).alias("i"), "level", "title")


def outlines(files: DataFrame, text_col: str = "body", key: str = "folder", limit: int = OUTLINE) -> DataFrame:
    """key, n_headers and ``outline``: the first headers, indented by level."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"), F.lit("\n"))
    rows = headers(files, text_col, key).withColumn("line", line)
    first = F.array_sort(F.collect_list(F.when(F.col("i") < limit, F.struct("i", "line"))))
    made = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_headers"), F.array_join(F.transform(first, lambda x: x["line"]), "").alias("outline"))
    out = files.select(key).join(made, key, "left")
    return out.select(key, F.coalesce("n_headers", F.lit(0)).cast("long").alias("n_headers"), F.coalesce("outline", F.lit("")).alias("outline"))


def preview(text: str | Column, limit: int = PREVIEW) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.substr(t, F.lit(1), F.lit(limit)), F.when(F.length(t) > limit, F.lit(CUT)).otherwise(F.lit("")))


def title(content: str | Column, folder: str | Column) -> Column:
    """The first ``#`` header of the file, else the folder's name."""
    c, f = (F.col(x) if isinstance(x, str) else x for x in (content, folder))
    found = F.regexp_extract(c, rf"(?md)^#[{SPACE}]+(.+)$", 1)
    return F.when(found != "", found).otherwise(f)


TEMPLATE = """# 章节分析

章节：{}
字数：{}
结构：
{}
正文：
{}
"""


def prompts(files: DataFrame, template: str = TEMPLATE, name: str = "folder") -> DataFrame:
    """folder, title, word_count and ``prompt`` of files (folder, content); name: the column that an untitled file is
    called after."""
    b = files.withColumn("body", body("content"))
    rows = b.join(outlines(b), "folder").withColumns({"title": title("content", name), "word_count": cjk_count("body")})
    parts = [F.lit(p) for p in template.split("{}")]
    filled = F.concat(parts[0], "title", parts[1], F.col("word_count").cast("string"), parts[2], "outline", parts[3], preview("body"), parts[4])
    return rows.select("folder", "title", "word_count", "n_headers", filled.alias("prompt"))


def prompts_of_folders(files: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """folder (its whole path), title, word_count, n_headers, ``prompt`` and ``file_name`` for each numbered folder of
    chapter files (path, content as text)."""
    named = files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("name"), F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "content")
    first = named.filter(_is_chapter(F.col("name"), F.col("file_name"))).groupBy("folder", "name").agg(F.min_by("content", "file_name").alias("content"))
    return prompts(first, template, "name").withColumn("file_name", F.lit(FILE_NAME))
