"""Zip containers: books and Word files, from the rows of the binaryFile source (path, content). A file that can't be read
gives no rows; its error stands in :func:`readable`."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from .parse import BOOK_ENCODINGS, decode, repair_mojibake
from .shipping import ship

_DC, _OPF, _BOX = "{http://purl.org/dc/elements/1.1/}", "{http://www.idpf.org/2007/opf}", "{urn:oasis:names:tc:opendocument:xmlns:container}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_book(data: bytes) -> tuple[dict[str, str | None], dict[str, str]]:
    """Metadata (first title, creator, publisher) and the XHTML files by name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("META-INF/container.xml")).find(f".//{_BOX}rootfile").get("full-path")
        package, base = ET.fromstring(z.read(root)), posixpath.dirname(root)
        meta = {k: next((e.text for e in package.iter(f"{_DC}{k}")), None) for k in ("title", "creator", "publisher")}
        files = {}
        for item in package.iter(f"{_OPF}item"):
            if item.get("media-type") != "application/xhtml+xml" or "nav" in (item.get("properties") or "").split():
                continue
            name = unquote(item.get("href"))
            raw = z.read(posixpath.normpath(posixpath.join(base, name)))
            try:
                text = repair_mojibake(raw.decode("utf-8"))
            except UnicodeDecodeError:
                text = decode(raw, BOOK_ENCODINGS, lenient=True)
            if text:
                files[name] = text
        return meta, files


def _on(toggle) -> bool:
    return toggle is not None and toggle.get(f"{_W}val", "true") not in ("0", "false", "off")


def read_word(data: bytes) -> list[tuple]:
    """Runs (pos, run_no, text, size, bold, italic, font, style_name, alignment) of the paragraphs of the body."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None
    rows = []
    for pos, p in enumerate(body.findall(f"{_W}p")):
        style, align = p.find(f"{_W}pPr/{_W}pStyle"), p.find(f"{_W}pPr/{_W}jc")
        style_name = names.get(style.get(f"{_W}val")) or style.get(f"{_W}val") if style is not None else "Normal"
        where = {"center": "center", "right": "right", "end": "right", "both": "justify"}.get(align.get(f"{_W}val") if align is not None else "", "left")
        for n, r in enumerate(p.iter(f"{_W}r")):
            text = "".join(e.text or "" if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" else "\n" if e.tag == f"{_W}br" else "" for e in r)
            size, font = r.find(f"{_W}rPr/{_W}sz"), r.find(f"{_W}rPr/{_W}rFonts")
            rows.append((pos, n, text, float(size.get(f"{_W}val")) / 2 if size is not None else None, _on(r.find(f"{_W}rPr/{_W}b")), _on(r.find(f"{_W}rPr/{_W}i")), font.get(f"{_W}ascii") if font is not None else None, style_name, where))
    return rows


def _attempt(f: Callable[[bytes], Any], data: bytes) -> tuple[Any, str | None]:
    """What f makes of the bytes, or its error. Damaged archives raise errors of many kinds (zip, zlib, XML, encryption,
    names that are missing), and each file fails alone: any of them means that the file can't be read."""
    try:
        return f(data), None
    except Exception as e:  # noqa: BLE001
        return None, f"{type(e).__name__}: {e}"


def readable(files: DataFrame, kind: str) -> DataFrame:
    """path and ``error`` (null if the container can be read) of files of kind ``epub`` or ``docx``."""
    reader = {"epub": read_book, "docx": read_word}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_attempt(reader, d)[1] for d in batch.column(1).to_pylist()], pa.string())], names=["path", "error"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, error string")


def book_files(files: DataFrame) -> DataFrame:
    """path, file_path, html, title, author, publisher: a row for each XHTML file of each book."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made, error = _attempt(read_book, data)
                if error is None:
                    meta, own = made
                    columns = [[path] * len(own), list(own), list(own.values()), *([meta[k]] * len(own) for k in ("title", "creator", "publisher"))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "file_path", "html", "title", "author", "publisher"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, file_path string, html string, title string, author string, publisher string")


def word_runs(files: DataFrame) -> DataFrame:
    """Runs of Word files: the input of ``operators.docx.paragraphs_from_runs``, with path in the place of doc_id."""
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string()]
    names = ["pos", "run_no", "text", "size", "bold", "italic", "font", "style_name", "alignment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, error = _attempt(read_word, data)
                if error is None:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "doc_id string, pos int, run_no int, text string, size double, bold boolean, italic boolean, font string, style_name string, alignment string")
