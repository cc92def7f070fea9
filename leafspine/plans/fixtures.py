"""Structure for the registered queries: the tables hold none, so lines get marks by their position, alike in Spark
and in SQL. Every row of a table takes part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.txt import split_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: (period, {position: SQL expression over line}) for each kind of text.
TXT = (19, {0: "'# ' || line", 3: "'- ' || line", 4: "'2) ' || line", 5: "'> ' || line", 7: "CASE WHEN pos % 2 = 1 THEN '```py' ELSE '```' END", 9: "''", 10: "'```'", 11: "'第3章 ' || line", 12: "'## ' || line", 13: "'**' || line", 15: "'1. ' || line", 17: "'> ' || line", 18: "'>'"})
MD = (17, {1: "'# ' || line", 3: "'## ' || line", 4: "'### ' || line", 5: "'- ' || line", 6: "'1. ' || line", 7: "'> ' || line", 8: "'```py'", 9: "''", 11: "'2) ' || line", 14: "'> > ' || line"})
CODE_HASH = (7, {1: "'# ' || line", 2: "'  # ' || line", 4: "'# === ' || line", 5: "'#'"})
CODE_C = (11, {1: "'// ' || line", 2: "'/* ' || line", 3: "' * ' || line", 4: "' */'", 6: "'/** ' || line", 7: "line || ' */'", 9: "'//'"})


def marked(lines: DataFrame, marks: tuple[int, dict[int, str]]) -> DataFrame:
    return lines.withColumn("line", F.expr(case_of(marks)))


def case_of(marks: tuple[int, dict[int, str]]) -> str:
    period, at = marks
    return "CASE " + " ".join(f"WHEN pos % {period} = {p} THEN {e}" for p, e in at.items()) + " ELSE line END"


def headed(lines: DataFrame, head: str) -> DataFrame:
    """Every line whole, at an odd position, and before some of them a short heading of its own: head is SQL over doc_id
    and pos, null where none stands."""
    rows = F.array(F.struct((F.col("pos") * 2).alias("pos"), F.expr(head).alias("line")), F.struct((F.col("pos") * 2 + 1).alias("pos"), F.col("line").alias("line")))
    return lines.select("doc_id", F.explode(F.filter(rows, lambda r: r["line"].isNotNull())).alias("r")).select("doc_id", "r.pos", "r.line")


#: SQL over pos and line, the same in both dialects.
XML_PIECE = """CASE WHEN doc_id % 5 = 0 THEN line WHEN pos % 4 = 0 THEN '<Title>' || line || '</Title>' WHEN pos % 4 = 1 THEN '<item a="b"><b>' || line || '</b></item>'
  WHEN pos % 4 = 2 THEN '<section> </section><SECTION x="1">' || line || '</SECTION>' ELSE '<entry>' || line END"""
RTF_HEAD = "{\\rtf1\\ansi\\deff0 }{\\fonttbl "
RTF_PIECE = """CASE WHEN pos = 0 AND doc_id % 3 = 0 THEN 'Part ' || line WHEN pos % 3 = 1 THEN chr(92) || 'par {' || chr(92) || 'b ' || line || '}' WHEN pos % 3 = 2 THEN chr(92) || 'fs24' || line || chr(92) || 'tab ' ELSE line END"""
EXT = "CASE doc_id % 7 WHEN 0 THEN 'py' WHEN 1 THEN 'kt' WHEN 2 THEN 'lua' WHEN 3 THEN 'yml' WHEN 4 THEN 'cs' WHEN 5 THEN 'toml' ELSE 'sh' END"

#: Laid-out lines made from document lines and headings: (name, SQL over doc_id, pos, line and the names before it).
PDF_HEAD = """CASE WHEN pos % 37 = 5 THEN 'Notes' WHEN pos % 41 = 6 THEN '【章】' WHEN pos % 43 = 8 THEN '- 12 -'
  WHEN pos % 11 IN (0, 4, 7) OR pos % 23 IN (1, 2) THEN concat('Abschnitt ', pos, ' von ', doc_id) END"""
PDF_COLUMNS = [
    ("page_num", "cast(floor(pos / 20) as int)"),
    ("font_size", "cast(CASE WHEN pos % 26 = 19 THEN 14.0 WHEN pos % 2 = 1 THEN 12.0 WHEN pos % 74 = 10 OR pos % 22 = 0 OR pos % 46 IN (2, 4) THEN 18.0 WHEN pos % 22 = 8 THEN 15.0 WHEN pos % 22 = 14 THEN 13.5 ELSE 12.0 END as double)"),
    ("text", "CASE WHEN pos % 2 = 1 AND pos % 5 = 0 THEN concat(line, '。') ELSE line END"),
    ("x0", "cast(CASE WHEN pos % 3 = 0 THEN 72.0 ELSE 96.0 END as double)"),
    ("x1", "cast(CASE WHEN pos % 3 = 0 THEN 72.0 ELSE 96.0 END as double) + cast(least(length(text) * 5, 400) as double)"),
    ("y0", "cast(40 + (pos % 20) * 37 as double)"),
    ("y1", "cast(40 + (pos % 20) * 37 + CASE WHEN font_size = 12.0 THEN 30 ELSE 14 END as double)"),
    ("page_width", "cast(600 as double)"),
    ("page_height", "cast(780 as double)"),
]
#: A table of contents in front of the lines, and before the first lines the headings it names, each in one piece or in
#: two: (SQL for k, n, page, size, text, filter). Every fourth document has none.
TOC_Y = "cast(40 + (pos % 20) * 37 as double)"
TOC_TITLE = "concat('Entry ', pos, ' of ', doc_id)"
TOC_PARTS = [
    ("0", "0", "1", "22.0", "'目录'", "pos = 0 AND doc_id % 4 <> 0"),
    ("1", "pos", "1", "CASE WHEN pos % 5 < 2 THEN 20.0 ELSE 16.0 END", f"CASE WHEN pos % 5 = 0 THEN concat('第1篇 ', {TOC_TITLE}) ELSE {TOC_TITLE} END", "pos < 8"),
    ("2", "pos * 3", "3 + cast(floor(pos / 10) as int)", "CASE WHEN pos % 4 = 1 THEN 18.0 ELSE 12.0 END", f"CASE WHEN pos % 3 = 0 THEN {TOC_TITLE} ELSE substr({TOC_TITLE}, 1, 6) END", "pos < 8"),
    ("2", "pos * 3 + 1", "3 + cast(floor(pos / 10) as int)", "12.0", f"substr({TOC_TITLE}, 7, 40)", "pos < 8 AND pos % 3 <> 0"),
    ("2", "pos * 3 + 2", "3 + cast(floor(pos / 10) as int)", "CASE WHEN pos % 9 = 8 THEN 18.0 ELSE 12.0 END", "line", "pos >= 0"),
]


def pdf_lines(lines: DataFrame) -> DataFrame:
    for name, e in PDF_COLUMNS:
        lines = lines.withColumn(name, F.expr(e))
    return lines.drop("line")


def toc_lines(lines: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    parts = [F.when(F.expr(where), F.struct(F.expr(k).alias("k"), F.expr(n).cast("long").alias("n"), F.expr(page).cast("int").alias("page_num"), F.expr(size).cast("double").alias("font_size"), F.expr(text).alias("text"))) for k, n, page, size, text, where in TOC_PARTS]
    rows = lines.select("doc_id", F.explode(F.filter(F.array(*parts), lambda r: r.isNotNull())).alias("r")).select("doc_id", "r.*")
    rows = rows.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "n")) - 1)).drop("k", "n")
    return rows.withColumns({"x0": F.lit(72.0), "x1": F.lit(300.0), "y0": F.expr(TOC_Y), "y1": F.expr(TOC_Y) + 14, "page_width": F.lit(600.0), "page_height": F.lit(780.0)})


#: Word paragraphs made from document lines and headings.
DOCX_HEAD = "CASE pos % 11 WHEN 2 THEN concat('第2章 ', doc_id) WHEN 4 THEN concat('1. ', doc_id) WHEN 6 THEN concat('Kurz ', doc_id) END"
DOCX_COLUMNS = [
    ("text", "line"),
    ("style_name", "CASE WHEN doc_id % 3 = 0 AND pos % 9 = 0 THEN 'Heading 1' WHEN doc_id % 3 = 0 AND pos % 9 = 3 THEN '标题 2' WHEN pos % 9 = 5 THEN 'heading 3' WHEN pos % 17 = 7 THEN 'My Heading' ELSE 'Normal' END"),
    ("font_size", "cast(CASE WHEN pos % 7 = 0 THEN 18.0 WHEN pos % 7 = 1 THEN 14.0 WHEN pos % 7 = 2 THEN 13.0 WHEN pos % 7 = 3 THEN null ELSE 12.0 END as double)"),
    ("is_bold", "pos % 4 = 0"),
    ("is_centered", "pos % 6 = 0"),
]
#: Recognised lines made from document lines and headings.
OCR_HEAD = "CASE pos % 9 WHEN 0 THEN concat('第1章 ', doc_id) WHEN 2 THEN concat('3、', doc_id) WHEN 7 THEN concat('12. 中', doc_id) WHEN 8 THEN concat('part 3 ', doc_id) END"
OCR_COLUMNS = [
    ("text", "CASE WHEN pos % 18 = 7 THEN concat('（二）', line) WHEN pos % 18 = 9 THEN concat('- ', line) WHEN pos % 18 = 11 THEN concat('「', line) ELSE line END"),
    ("confidence", "cast(CASE WHEN pos % 5 = 3 THEN 0.5 ELSE 0.75 END as double)"),
]
#: Chapter files made from documents: a header between rules, and a body with headers.
PROMPT_CONTENT = """'# ' || source || chr(10) || '---' || chr(10) || 'x' || chr(10) || '---' || chr(10) || '## 第一节 ' || lang || chr(10) || replace(text, chr(10), chr(10) || '### ') || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '---' || chr(10) || 'tail' ELSE '' END"""
EXTENSION_LIST = ["pdf", "EPUB", "doc", "xhtml", "md", "jsonl", "tab", "opml", "rtf", "kts", "txt", "png", "svelte"]


def with_columns(lines: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    for name, e in columns:
        lines = lines.withColumn(name, F.expr(e))
    return lines

#: Lines and titles of books.
BOOK = (13, {0: "'第三章：' || line", 2: "'第2节 ' || line", 3: "'Chapter 4: ' || line", 4: "'part 7'", 5: "'12. ' || line", 6: "'（3）、' || line", 8: "'三、' || line", 9: "'CHAPTER IX'"})
BOOK_HEAD = "CASE pos % 6 WHEN 0 THEN concat('第9章 ', doc_id) WHEN 2 THEN concat('附录 ', doc_id) WHEN 3 THEN concat('12. ', doc_id) WHEN 4 THEN concat('Ende ', doc_id, '！') WHEN 5 THEN concat(doc_id, ' Contents') END"
#: Reserved characters before the whole text.
NAME = """CASE WHEN doc_id % 50 = 0 THEN ' . ' WHEN doc_id % 2 = 0 THEN concat(' ./a?b*c:d"e<f>g|h', chr(92), 'i', chr(13), '.. ', text) ELSE concat(' ./', text) END"""
#: Tags, styles and class names of elements; the class name holds the whole text.
TAGS = ["h1", "h3", "p", "ul", "blockquote", "pre", "table", "span", "script"]
CLASS = "concat(CASE doc_id % 3 WHEN 0 THEN 'Item strong ' WHEN 1 THEN 'plain ' ELSE '' END, text)"
STYLE = "concat(CASE doc_id % 7 WHEN 0 THEN 'Font-Weight: 700; text-align: right' WHEN 1 THEN 'font-style: italic; text-align: center' WHEN 2 THEN 'text-align:left' ELSE '' END, '; content: ', text)"
#: Sizes in all units.
FONT_HEAD = "CASE WHEN pos % 3 = 0 THEN concat('Heading ', pos, ' of ', doc_id) END"
FONT_STYLE = "concat('x: 1; font-size: ', pos % 5 + 10, CASE WHEN pos % 4 = 0 THEN 'pt' WHEN pos % 4 = 1 THEN 'PX' WHEN pos % 4 = 2 THEN 'em' ELSE '' END)"
