"""Operator 2, benchmark decontamination: a broadcast set of normalised benchmark n-grams, scanned over documents.

A window is ``n`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit. Words of a document are looked up in the vocabulary of the
benchmark, windows of known words are hashed and looked up in the sorted hashes, and each candidate is verified
against the exact words.

The benchmark is broadcast in chunks of at most ``max_chunk_bytes`` of text: its size is summed first. A window takes
12 bytes (hash and place) and a word 4, beside the vocabulary, so a chunk takes a worker about five times its text. A
benchmark beyond the bound is scanned in several passes, each a stage of its own whose rows are written to the shared
folder with the hits so far, so that no worker holds two chunks. No pass shuffles.

Defined results: a null or empty text (on either side) has no words, hits nothing and is hit by nothing; items with
the same id are one item; a null item id counts as no item, though its windows hit; repeated documents each get
their row; with an empty benchmark nothing is hit; extra columns are ignored by :func:`scan` (carried ones that are
named like a result give way to it) and kept by :func:`decontaminate`, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Positional, release, ship, stored

#: Bytes outside words become blanks, A-Z become a-z; every byte of a code point from U+0080 on is a word byte.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive word ids."""
    size = len(ids) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out + ids[k : k + size].astype(np.uint64)) * _MULT
            out ^= out >> np.uint64(29)
    return out


class Windows:
    """The windows of one chunk of the benchmark: the words of all items one after the other, as numbers, and for each
    window size the hashes of the windows, sorted, with the place where each begins."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        numbers, ends, starts = array("I"), [], {}
        self.items: list[str | None] = []
        for item_id, text in items:
            first = len(numbers)
            numbers.extend([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)])
            if size := min(n, len(numbers) - first):
                starts.setdefault(size, []).append(np.arange(first, len(numbers) - size + 1, dtype=np.uint32))
                self.items.append(item_id)
                ends.append(len(numbers))
        self.words, self.ends = np.array(numbers, dtype=np.uint32), np.array(ends, dtype=np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, own in starts.items():
            at = np.concatenate(own)
            hashes = _hashes(self.words, size)[at]
            order = np.argsort(hashes)
            self.by_size[size] = hashes[order], at[order]

    def scan(self, tokens: list[bytes], covered: np.ndarray, found: set[str]) -> None:
        """Mark the hit words in covered and add the ids of the items to found."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in tokens), dtype=np.uint32, count=len(tokens))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, (table, places) in self.by_size.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(starts):
                continue
            if len(starts) * 4 >= len(ids):
                hashes = _hashes(ids, size)[starts]
            else:
                hashes = np.zeros(len(starts), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(size):
                        hashes = (hashes + ids[starts + k].astype(np.uint64)) * _MULT
                        hashes ^= hashes >> np.uint64(29)
            low, high = np.searchsorted(table, hashes), np.searchsorted(table, hashes, side="right")
            for i, first, last in zip(*(x[low < high].tolist() for x in (starts, low, high)), strict=True):
                window, alike = ids[i : i + size], places[first:last]
                same = alike[(self.words[alike[:, None] + np.arange(size)] == window).all(axis=1)]
                if len(same):
                    covered[i : i + size] = True
                    found.update(x for k in np.searchsorted(self.ends, same, side="right") if (x := self.items[k]) is not None)


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, n: int, max_chunk_bytes: int) -> Iterator[tuple[bool, Windows]]:
    """The windows of each chunk, and whether it is the last."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull()).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-int(total) * 2 // max_chunk_bytes) if total > max_chunk_bytes else 1)
    for k in range(parts):
        part = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield k + 1 == parts, Windows([(r["i"], r["t"]) for r in part.toLocalIterator()], n)


RESULTS = ("__n_words", "__hit_runs", "__items")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, carry: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_chunk_bytes: int = 16 << 20) -> DataFrame:
    """The carried columns (by default all but the text) with ``__n_words``, ``__hit_runs`` (first and last word of
    each run of hit words, in turn) and ``__items`` (sorted ids of the items found)."""
    spark = docs.sparkSession
    ship(spark)
    carry = [c for c in docs.columns if c != text_col] if carry is None else carry
    p = Positional(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text_col])]))
    out = p.rows.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    schema, own = out.schema, len(p.names)
    text_at = p.rows.columns.index(p.of(text_col))
    for last, windows in _chunks(benchmark, item_col, item_text_col, n, max_chunk_bytes):
        shared = spark.sparkContext.broadcast(windows)

        def one_pass(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, runs, items = [], [], []
                for text, was, ids in zip(*(batch.column(i).to_pylist() for i in (text_at, own + 1, own + 2)), strict=True):
                    tokens = words(text)
                    covered, found = np.zeros(len(tokens), dtype=bool), set(ids)
                    for a, b in zip(was[::2], was[1::2], strict=True):
                        covered[a : b + 1] = True
                    shared.value.scan(tokens, covered, found)
                    counts.append(len(tokens))
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0])))) if covered.any() else np.zeros(0, dtype=np.int64)
                    edges[1::2] -= 1
                    runs.append(edges.astype(np.int32))
                    items.append(sorted(found))
                made = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:own], *made], names=batch.schema.names)
            release()

        out = out.mapInArrow(one_pass, schema)
        if not last:
            out = stored(out, "scanned")
            shared.destroy()
    kept = {c.lower() for c in carry}
    results = [F.col(c).alias(name) for c, name in zip(("n_words", "runs", "items"), RESULTS, strict=True)]
    return out.select(*[c for c, name in zip(p.back(), p.names, strict=True) if name.lower() in kept and name.lower() not in RESULTS], *results)


def n_hit(runs: str = "__hit_runs"):
    """The number of words in the runs."""
    pairs = F.sequence(F.lit(0), F.size(runs) - 2, F.lit(2))
    return F.when(F.size(runs) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, F.lit(0).cast("long"), lambda a, i: a + F.get(F.col(runs), i + 1) - F.get(F.col(runs), i) + 1))


def cut_runs(text: str, runs: list[int]) -> str:
    """The text without the hit words and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    kept, last = [], 0
    for first, end in zip(runs[::2], runs[1::2], strict=True):
        kept.append(raw[last : at[first][0]])
        last = at[end][1]
    return b"".join([*kept, raw[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = 10, text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a window (mode ``documents``), or with the hit words cut out of the
    text (mode ``spans``). The columns of docs are kept."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    p = Positional(docs)
    found = scan(p.rows, benchmark, n, carry=p.rows.columns, text_col=p.of(text_col), **options)
    if mode == "documents":
        return found.filter(F.size("__hit_runs") == 0).select(*p.back())
    at = p.rows.columns.index(p.of(text_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_runs(t, r) if r else t for t, r in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    return found.drop("__n_words", "__items").mapInArrow(cut, p.rows.schema).select(*p.back())
