"""Chapters as Markdown files: bodies, headers, paths and names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_count, safe_filename, strip
from ..plans.segment import joined
from ..plans.storage import stored
from ..sources.shipping import ship

#: Marks of the first three levels.
MARKS = {1: "【章】", 2: "【节】", 3: "【小节】"}
EMPTY_BODY = "*（本章内容为空）*"


def level_mark(level: str | Column) -> Column:
    n = F.col(level) if isinstance(level, str) else level
    out = F.concat(F.lit("【层级"), n.cast("string"), F.lit("】"))
    for k, mark in MARKS.items():
        out = F.when(n == k, mark).otherwise(out)
    return out


def heading_mark(type_: Column, level: Column, text: Column) -> Column:
    """Titles and headings get one to six hashes."""
    hashes = F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), level)))
    return F.when(type_.isin("title", "heading"), F.concat(hashes, F.lit(" "), text)).otherwise(text)


def bodies(blocks: DataFrame) -> DataFrame:
    """doc_id, chapter_index and ``body`` from blocks (doc_id, chapter_index, pos, type, level, text): non-empty texts,
    marked, with blank lines between."""
    t = strip("text")
    marked = F.when(t != "", heading_mark(F.col("type"), F.col("level"), t))
    return blocks.groupBy("doc_id", "chapter_index").agg(joined(marked, "\n\n").alias("body"))


def render(chapters: DataFrame, made_at: str, footer: str = "") -> DataFrame:
    """chapters (doc_id, chapter_index, title, level, body, hierarchy_path) with ``markdown``, ``word_count`` and
    ``file_name``. made_at is a parameter, so that results can be repeated."""
    n = F.col("chapter_index").cast("string")
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("第"), n, F.lit("章")))
    words = F.length(F.coalesce("body", F.lit("")))
    lines = [
        F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), title), F.lit(""), F.lit("---"), F.lit(""),
        F.concat(F.lit("**章节序号**：第"), n, F.lit("章  ")), F.concat(F.lit("**章节层级**："), F.col("level").cast("string"), F.lit(" "), level_mark("level"), F.lit("  ")),
        F.concat(F.lit("**层级路径**："), F.coalesce("hierarchy_path", n), F.lit("  ")), F.concat(F.lit("**字数统计**："), words.cast("string"), F.lit(" 字  ")),
        F.lit(f"**生成时间**：{made_at}  "), F.lit(""), F.lit("---"), F.lit(""), F.coalesce(F.nullif("body", F.lit("")), F.lit(EMPTY_BODY)), F.lit(""), F.lit("---"), F.lit(""), F.lit(footer),
    ]
    path = F.replace(F.coalesce("hierarchy_path", n), F.lit("."), F.lit("_"))
    name = F.concat(path, F.lit("_"), safe_filename(F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("chapter_"), n))), F.lit(".md"))
    return chapters.withColumns({"markdown": F.concat_ws("\n", *lines), "word_count": words.cast("long"), "display_count": display_count(F.coalesce("body", F.lit(""))), "file_name": name})


def hierarchy(chapters: DataFrame) -> DataFrame:
    """chapters (doc_id, chapter_id, parent_id, chapter_index) with ``hierarchy_path``, indexes from the root down, at
    any depth. Rows whose ancestors are missing or form a circle have no root and are left out.

    Each round joins every open row with the ancestor it has reached, so the known part of a path doubles: a tree of
    depth n takes log2(n) rounds. Rows whose ancestor is finished finish in that round; if none did, the rest are circles.
    What a round made is written to the shared folder, so rows should carry no texts.
    """
    step = stored(chapters.withColumns({"__up": F.col("parent_id").cast("string"), "__path": F.col("chapter_index").cast("string")}), "paths")
    opened = step.filter("__up is not null").count()
    while opened:
        above = step.select("doc_id", F.col("chapter_id").cast("string").alias("__up"), F.col("__up").alias("__next"), F.col("__path").alias("__above"))
        moved = step.filter("__up is not null").join(above, ["doc_id", "__up"]).withColumns({"__up": F.col("__next"), "__path": F.concat("__above", F.lit("."), "__path")})
        step = stored(step.filter("__up is null").unionByName(moved.select(*step.columns)), "paths")
        before, opened = opened, step.filter("__up is not null").count()
        if opened == before:
            break
    return step.filter("__up is null").withColumnRenamed("__path", "hierarchy_path").drop("__up")


def write_files(rows: DataFrame, directory: str, mounted: bool = False) -> DataFrame:
    """Write rows (folder, file_name, text) to ``directory/folder/file_name`` from the tasks; folder and file of each.

    directory is a URI of a store that all tasks see (file, hdfs, s3, gs) or a local path. On a cluster a local path is
    taken only if ``mounted`` says that it is the same folder on every machine: each executor would write to a disk of
    its own. A file is written whole under another name and moved, so a retried task leaves one result.
    """
    local = "://" not in directory or directory.startswith("file:")
    if local and not mounted and not rows.sparkSession.sparkContext.master.startswith("local["):
        raise ValueError("a local folder isn't shared by the executors: name a URI of a shared store, or say that it is mounted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(directory) if ":/" in directory else (fs.LocalFileSystem(), directory)
        for batch in batches:
            files = []
            for folder, name, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = f"{root.rstrip('/')}/{folder}"
                store.create_dir(own, recursive=True)
                part, whole = f"{own}/.{uuid.uuid4().hex}", f"{own}/{name}"
                with store.open_output_stream(part) as f:
                    f.write(text.encode())
                if not local and store.get_file_info(whole).type != fs.FileType.NotFound:
                    store.delete_file(whole)
                store.move(part, whole)
                files.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string())], names=["folder", "file"])

    ship(rows.sparkSession)
    return rows.select("folder", "file_name", "text").mapInArrow(run, f"folder {dict(rows.dtypes)['folder']}, file string")


def write_markdown(rendered: DataFrame, directory: str, mounted: bool = False) -> DataFrame:
    """Write each chapter to ``directory/doc_id/file_name`` (:func:`write_files`); doc_id and file of each."""
    rows = rendered.select(F.col("doc_id").alias("folder"), "file_name", F.col("markdown").alias("text"))
    return write_files(rows, directory, mounted).withColumnRenamed("folder", "doc_id")


def summary(files: DataFrame, chapters: DataFrame, requested: DataFrame) -> DataFrame:
    """One row a requested document (doc_id, path, exists): success, number of chapters and the files written."""
    made = chapters.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chapters"))
    written = files.groupBy("doc_id").agg(F.array_sort(F.collect_list("file")).alias("files"))
    out = requested.join(made, "doc_id", "left").join(written, "doc_id", "left")
    ok = F.col("exists") & (F.coalesce("chapters", F.lit(0)) > 0)
    return out.select("doc_id", "path", ok.alias("success"), F.coalesce("chapters", F.lit(0)).cast("long").alias("chapters"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))
