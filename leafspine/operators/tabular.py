"""CSV rows and JSON values as chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.segment import joined


def csv_header(rows: DataFrame) -> DataFrame:
    """The header chapter of each document of rows (doc_id, row_no from 0, cells)."""
    head = rows.filter("row_no = 0")
    text = F.concat(F.lit("列数: "), F.size("cells").cast("string"), F.lit("\n列名: "), F.array_join("cells", ", "))
    return head.select("doc_id", F.lit(1).alias("chapter_index"), F.lit("表头信息").alias("title"), text.alias("text"), F.length(text).cast("long").alias("word_count"), F.lit(1).cast("long").alias("paragraph_count"))


def row_text(headers, cells):
    """``k=v; k=v``: the shorter of the two decides, a repeated header keeps its first place and its last value."""
    n = F.least(F.size(headers), F.size(cells))
    names = F.slice(headers, 1, n)
    first = F.filter(F.sequence(F.lit(1), n), lambda i: F.array_position(names, F.get(names, i - 1)) == i)
    last = lambda i: n - F.array_position(F.reverse(names), F.get(names, i - 1)).cast("int")
    pairs = F.transform(first, lambda i: F.concat(F.get(names, i - 1), F.lit("="), F.get(cells, last(i))))
    return F.when(n > 0, F.array_join(pairs, "; ")).otherwise(F.when(F.size(cells) > 0, F.lit("")))


def csv_chunks(rows: DataFrame, size: int = 10) -> DataFrame:
    """A chapter for every ``size`` data rows: title, the table's caption, one line a row that isn't blank."""
    head = rows.filter("row_no = 0").select("doc_id", F.col("cells").alias("headers"))
    data = rows.filter("row_no > 0").join(head, "doc_id")
    total = F.max("row_no").over(Window.partitionBy("doc_id"))
    data = data.withColumns({"chunk": F.floor((F.col("row_no") - 1) / size).cast("int"), "total": total, "line": row_text(F.col("headers"), F.col("cells"))})
    made = data.groupBy("doc_id", "chunk").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("n"), joined(F.col("line"), "\n", "row_no").alias("text"))
    start = F.col("chunk") * size
    return made.select(
        "doc_id", (F.col("chunk") + 2).alias("chapter_index"), F.concat(F.lit("数据行 "), (start + 1).cast("string"), F.lit("-"), F.least(start + size, "total").cast("string")).alias("title"),
        F.concat(F.lit("表格数据 ("), F.col("n").cast("string"), F.lit(" 行)")).alias("caption"), "text", F.length("text").cast("long").alias("word_count"), F.col("n").alias("paragraph_count"),
    )


def json_object_chapters(docs: DataFrame, json_col: str = "content", doc_col: str = "doc_id") -> DataFrame:
    """A chapter for every key of objects whose values are scalars, in order; JVM only. Nested values: see
    ``sources.parse.json_chapters``."""
    pairs = docs.select(F.col(doc_col).alias("doc_id"), F.posexplode(F.from_json(json_col, "map<string,string>")).alias("i", "title", "text"))
    return pairs.select("doc_id", (F.col("i") + 1).alias("chapter_index"), "title", "text", F.length("text").cast("long").alias("word_count"))
