"""Routing files to readers by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The readers in the order in which they are asked, with their extensions.
READERS: dict[str, list[str]] = {
    "pdf": ["pdf"],
    "epub": ["epub"],
    "docx": ["docx", "doc"],
    "html": ["html", "htm", "xhtml"],
    "markdown": ["md", "markdown", "mdown", "mkd", "mkdn"],
    "json": ["json", "jsonl"],
    "csv": ["csv", "tsv", "tab"],
    "xml": ["xml", "xhtml", "xht", "rss", "atom", "opml"],
    "rtf": ["rtf"],
    "code": [
        "py", "pyw", "pyi", "pyc", "pyo", "js", "jsx", "ts", "tsx", "mjs", "cjs", "java", "class", "jar", "c", "cpp", "cc", "cxx", "h", "hpp", "hxx", "cs", "csx", "go", "rs", "rlib",
        "rb", "rbw", "php", "php3", "php4", "php5", "phtml", "swift", "kt", "kts", "scala", "sc", "pl", "pm", "sh", "bash", "zsh", "fish", "ps1", "psm1", "sql", "css", "scss", "sass",
        "less", "yaml", "yml", "toml", "ini", "conf", "cfg", "properties", "env",
    ],
    "txt": ["txt", "md", "markdown"],
}


def extension(path: str | Column) -> Column:
    """In lower case, without the dot; empty without one."""
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(p, r"[^/]\.([^./]+)$", 1))


def file_name(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"([^/]*)$", 1)


def reader(path: str | Column) -> Column:
    """The first reader that takes the extension; null if none does."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for name, exts in reversed(READERS.items()):
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def file_info(files: DataFrame) -> DataFrame:
    """path, file_name, file_format, size and reader of files (path, length), as the binaryFile source lists them."""
    return files.select("path", file_name("path").alias("file_name"), extension("path").alias("file_format"), F.coalesce("length", F.lit(0)).cast("long").alias("size"), reader("path").alias("reader"))


def supported_formats(spark) -> DataFrame:
    rows = [(i, name, e) for i, (name, exts) in enumerate(READERS.items()) for e in exts]
    df = spark.createDataFrame(rows, "priority int, reader string, ext string")
    return df.groupBy("ext").agg(F.min_by("reader", "priority").alias("reader"))


def with_ocr_fallback(documents: DataFrame, recognised: DataFrame, least_words: int = 1000, replace_always: bool = True) -> DataFrame:
    """documents (doc_id, file_format, total_words, ...) where PDF with few words take the recognised result (same
    columns), even an empty one; with replace_always off only one that has words."""
    thin = (F.col("file_format") == "pdf") & (F.col("total_words") < least_words)
    other = recognised.select("doc_id", *[F.col(c).alias(f"r_{c}") for c in documents.columns if c not in ("doc_id", "file_format")])
    joined = documents.join(other, "doc_id", "left")
    use = thin & (F.lit(replace_always) | (F.coalesce("r_total_words", F.lit(0)) > 0))
    return joined.select("doc_id", "file_format", *[F.when(use, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) for c in documents.columns if c not in ("doc_id", "file_format")], use.alias("used_ocr"))
