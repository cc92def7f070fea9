"""Sources whose structure needs a parser: JSON of any depth, CSV text, byte decoding. Arrow batches in and out."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shipping import ship

#: The keys that give an array element its title, in order.
TITLE_KEYS = ("title", "name", "chapter", "section", "heading", "topic")
UTF8_FIRST = ("utf-8", "gbk", "gb2312", "latin-1")
CODE_ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1", "cp1252")
BOOK_ENCODINGS = ("utf-8", "gbk", "gb2312", "gb18030", "big5")


def decode_as(data: bytes, encodings: tuple[str, ...] = UTF8_FIRST, lenient: bool = False) -> tuple[str, str]:
    """The text and the first encoding that fits; lenient: bytes that are no UTF-8 are left out if none does."""
    for name in encodings:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    if lenient:
        return data.decode("utf-8", "ignore"), "utf-8-ignore"
    raise ValueError("no encoding fits")


def decode(data: bytes, encodings: tuple[str, ...] = UTF8_FIRST, lenient: bool = False) -> str:
    return decode_as(data, encodings, lenient)[0]


def as_text(value) -> str:
    """Text of a JSON value: ``key: value`` and ``[i] value`` lines, scalars as Python writes them."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return "\n".join([f"{k}: {as_text(v)}" for k, v in value.items()])  # lists, not generators: one frame a level
    if isinstance(value, list):
        return "\n".join([f"[{i}] {as_text(v)}" for i, v in enumerate(value, 1)])
    return str(value)


def _element_title(item, number: int) -> str:
    named = next((str(item[k]) for k in TITLE_KEYS if k in item), "") if isinstance(item, dict) else ""
    return named or f"第{number}项"


def _elements(content: str) -> list[tuple[str, str]]:
    """(title, text) of the elements of JSON or JSON lines; raises for what is neither, nested too deeply or, with its
    escapes resolved, no Unicode text."""
    try:
        data = json.loads(content)
    except json.JSONDecodeError:
        data = [json.loads(line) for line in content.split("\n") if line.strip()]
    pairs = []
    if isinstance(data, dict):
        pairs = [(str(k), as_text(v)) for k, v in data.items()]
    elif isinstance(data, list):
        pairs = [(_element_title(x, i), as_text(x)) for i, x in enumerate(data, 1)]
    for pair in pairs:
        "".join(pair).encode()
    return pairs


def chapters_of_json(content: str) -> list[tuple[int, str, str, str]]:
    """(index, title, text, type) of the chapters of JSON or JSON lines; anything else, nesting beyond Python's stack and
    halves of surrogate pairs included, is one code chapter with the raw content."""
    try:
        pairs = _elements(content)
    except (ValueError, RecursionError):
        pairs = []
    return [(i, t, x, "paragraph") for i, (t, x) in enumerate(pairs, 1)] or [(1, "JSON内容", content, "code")]


def json_chapters(docs: DataFrame) -> DataFrame:
    """Chapters of documents (doc_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *c) for d, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in chapters_of_json(content or "")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.string()) for i in (2, 3, 4)),
                 pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([r[3].count("\n\n") + 1 if r[4] == "paragraph" else 1 for r in rows], pa.int64())],
                names=["doc_id", "chapter_index", "title", "text", "type", "word_count", "paragraph_count"],
            )

    ship(docs.sparkSession)
    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, chapter_index int, title string, text string, type string, word_count long, paragraph_count long")


def cells_of_csv(content: str, delimiter: str) -> list[list[str]]:
    """The rows of CSV text, read line by line; none at all if the text can't be read (a carriage return inside an
    unquoted cell). Cells may be of any length."""
    csv.field_size_limit(2**31 - 1)
    try:
        return list(csv.reader(content.split("\n"), delimiter=delimiter))
    except csv.Error:
        return []


def csv_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_no, cells) of documents (doc_id, ext, content); tab for tsv and tab files, comma for others. A file
    that can't be read gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, ext, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = cells_of_csv(content or "", "\t" if ext in ("tsv", "tab") else ",")
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), batch.column(0).type), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "row_no", "cells"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "ext", "content").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, row_no int, cells array<string>")


def decoded(files: DataFrame, encodings: tuple[str, ...] = UTF8_FIRST, lenient: bool = False) -> DataFrame:
    """files (as the binaryFile source gives them: path, length, content) with ``text`` and ``encoding`` instead of the
    bytes. Files whose bytes fit no encoding have null ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(1).to_pylist():
                try:
                    found.append(decode_as(data, encodings, lenient))
                except ValueError:
                    found.append((None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1))], names=["path", "text", "encoding"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, text string, encoding string")


def repair_mojibake(text: str) -> str:
    """GBK that was read as Latin-1, read again as GBK, if Latin letters with marks make up 30 % or more."""
    letters = sum(map(str.isalpha, text))
    if not letters or sum("\u0080" <= c <= "ɏ" for c in text) / letters < 0.3:
        return text
    try:
        return text.encode("latin-1").decode("gbk")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text
