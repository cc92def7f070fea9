"""Source code: comment runs, language names and the code document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, strip
from ..plans.segment import earlier, joined, last_known, running_segment

#: Names of languages by extension; other extensions name themselves.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "c": "c", "cpp": "cpp", "cs": "csharp", "go": "go",
    "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sql": "sql", "sh": "bash",
    "yaml": "yaml", "yml": "yaml", "json": "json", "css": "css", "scss": "scss", "html": "html", "xml": "xml",
}
HASH_FAMILY = ["py", "pyw", "sh", "bash", "yaml", "yml", "rb"]
SLASH_FAMILY = ["c", "cpp", "java", "js", "ts", "cs", "go", "rs", "swift", "kt"]
MARKUP_FAMILY = ["html", "htm", "xml", "css", "scss"]


def language(ext: str | Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, col(ext)), col(ext))


def _runs(lines: DataFrame) -> DataFrame:
    """Comments from lines (doc_id, pos, piece, flush): pieces between flushing lines, joined by a blank."""
    runs = lines.withColumn("run", running_segment(F.col("flush")))
    return runs.filter("piece is not null").groupBy("doc_id", "run").agg(F.min("pos").alias("pos"), joined(F.col("piece"), " ").alias("comment")).drop("run")


def hash_comments(lines: DataFrame) -> DataFrame:
    """Runs of lines that start with ``#``; rulers and empty comments are left out without ending a run."""
    s = strip("line")
    text = strip(F.substr(s, F.lit(2), F.length(s)))
    own = s.startswith("#")
    piece = F.when(own & (text != "") & ~text.startswith("===") & ~text.startswith("---"), text)
    return _runs(lines.select("doc_id", "pos", piece.alias("piece"), (~own).alias("flush")))


def slash_comments(lines: DataFrame) -> DataFrame:
    """Runs of ``//`` lines and of ``/* */`` blocks. A line that opens a block doesn't close it."""
    s = lines.withColumn("s", strip("line"))
    t, rest = F.col("s"), strip(F.substr("s", F.lit(3), F.length("s")))
    s = s.withColumn("kind", F.when(t.startswith("//"), "line").when(t.startswith("/*"), "open").when(t.endswith("*/"), "close"))
    state = last_known(F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", 0), earlier())
    s = s.withColumn("inside", F.coalesce(state, F.lit(0)) == 1)
    body = strip(F.regexp_replace("s", r"^\*+", ""))
    piece = F.when(F.col("kind") == "line", F.nullif(rest, F.lit(""))).when(F.col("kind") == "open", F.when(~rest.startswith("*"), F.nullif(rest, F.lit("")))).when(F.col("kind").isNull() & F.col("inside"), F.nullif(body, F.lit("")))
    flush = F.coalesce(F.col("kind") == "close", ~F.col("inside"))
    return _runs(s.select("doc_id", "pos", piece.alias("piece"), flush.alias("flush")))


def markup_comments(lines: DataFrame) -> DataFrame:
    """The first ``<!-- -->`` of each line; without an end it runs to the end of the line."""
    s = strip("line")
    start, end = F.instr(s, "<!--") + 4, F.instr(s, "-->")
    text = strip(F.substr(s, start, F.greatest(F.when(end > 0, end - start).otherwise(F.length(s) - start + 1), F.lit(0))))
    return lines.filter(F.instr(s, "<!--") > 0).select("doc_id", "pos", text.alias("comment")).filter("comment <> ''")


def code_documents(docs: DataFrame) -> DataFrame:
    """One chapter for each document (doc_id, name, ext, content)."""
    lines = F.filter(F.split("content", "\n", -1), lambda x: strip(x) != "")
    info = F.concat(F.lit("文件: "), F.col("name"), F.lit("\n语言: "), language("ext"))
    return docs.select("doc_id", F.concat(F.lit("代码: "), F.col("name")).alias("title"), info.alias("info"), language("ext").alias("language"), F.length("content").cast("long").alias("word_count"), F.size(lines).cast("long").alias("paragraph_count"))


def comments(lines: DataFrame) -> DataFrame:
    """Comments of lines (doc_id, ext, pos, line) by the family of the extension."""
    own = lambda exts: lines.filter(F.col("ext").isin(*exts)).drop("ext")
    return hash_comments(own(HASH_FAMILY)).unionByName(slash_comments(own(SLASH_FAMILY))).unionByName(markup_comments(own(MARKUP_FAMILY)))
