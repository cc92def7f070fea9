"""HTML as a relation of nodes. A tolerant parser: a start tag opens, void tags close at once, an end tag closes up to the
nearest open one of its name, other end tags are ignored; nothing else is closed before the end."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .shipping import ship

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Texts in these are no text of the elements around them.
SILENT = frozenset(("script", "style"))

NODES = "file_path string, pos int, end_pos int, parent int, tag string, depth int, source_line int, attr_title string, attr_class string, attr_style string, text string, lines string, n_strings int"
_FIELDS = ("pos", "end_pos", "parent", "tag", "depth", "source_line", "attr_title", "attr_class", "attr_style", "text", "lines", "n_strings")
_INTS = frozenset(("pos", "end_pos", "parent", "depth", "source_line", "n_strings"))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.strings: list[tuple[int, str]] = []
        self.serial = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.nodes.append({
            "pos": self.serial, "parent": self.nodes[self.open[-1]]["pos"] if self.open else -1, "tag": tag, "depth": len(self.open), "source_line": self.getpos()[0], "first": len(self.strings),
            "attr_title": a.get("title"), "attr_class": a.get("class"), "attr_style": a.get("style"),
        })
        self.serial += 1
        self.open.append(len(self.nodes) - 1)
        if tag in VOID:
            self._close(1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(1)

    def handle_endtag(self, tag):
        for n, i in enumerate(reversed(self.open), 1):
            if self.nodes[i]["tag"] == tag:
                self._close(n)
                return

    def handle_data(self, data):
        self.serial += 1
        if not self.open or self.nodes[self.open[-1]]["tag"] not in SILENT:
            self.strings.append((self.serial, data))

    def handle_comment(self, data):
        self.serial += 1

    def _close(self, n: int):
        for _ in range(n):
            node = self.nodes[self.open.pop()]
            own = [s.strip() for _, s in self.strings[node.pop("first") :]]
            own = [s for s in own if s]
            node |= {"end_pos": self.serial - 1, "text": "".join(own), "lines": "\n".join(own), "n_strings": len(own)}


def parse(html: str) -> list[dict]:
    """The elements of a page in document order: position (texts and comments count), position of the last descendant,
    parent, tag, depth, line, attributes, and the texts inside, stripped, joined without and with line ends."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tree._close(len(tree.open))
    return tree.nodes


def parsed(html: str) -> list[dict]:
    """:func:`parse`; no nodes of a page that the parser gives up on (a marked section that is none, as ``<![foo bar>``)."""
    try:
        return parse(html)
    except (AssertionError, ValueError):
        return []


def nodes(files: DataFrame) -> DataFrame:
    """Nodes of files (doc_id, file_path, html); doc_id of any type. A page that can't be parsed gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, path, html = (batch.column(k)[i].as_py() for k in range(3))
                made = parsed(html)
                columns = [pa.array([doc] * len(made), batch.column(0).type), pa.array([path] * len(made), pa.string())]
                columns += [pa.array([n[f] for n in made], pa.int32() if f in _INTS else pa.string()) for f in _FIELDS]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file_path", *_FIELDS])

    ship(files.sparkSession)
    return files.select("doc_id", "file_path", "html").mapInArrow(run, f"doc_id {dict(files.dtypes)['doc_id']}, {NODES}")
