"""Operator 4, token counts with a digest cache: normalised content and tokenizer version are digested, joined to
stored counts, only distinct misses are encoded, and their counts are appended to the cache.

The content is normalised by what every tokenizer here ignores or is told to ignore (``normalise``), so equal digests
mean equal counts.

1. Digests alone are counted and joined to the stored counts. A digest that is stored or stands in several rows is
   marked in a bitmap of fixed size (``BITMAP_BITS``, 16 MB), which is broadcast.
2. In one pass over the texts, rows whose digest isn't marked (misses that stand alone) are encoded where they are.
3. Marked rows, and those that share a bit with one, go on with their texts: copies fold before the shuffle, one record
   a task, what is stored is left out, and the rest is encoded once. A full bitmap costs a shuffle of all texts, and
   nothing else.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens) in a shared folder. A count that was
appended twice (two runs at once, a retried append) is read once. Without a given cache the table is made anew for
the call, in the folder of spark.checkpoint.dir.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); repeated rows each get their row; null ids
are kept; an empty table gives no rows and appends none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, scratch, ship, stored

#: Chunks whose counts a worker remembers, in two generations of this many.
MEMO = 300_000
#: Texts that are encoded at a time.
SLICE = 250
#: Bits that mark digests; an eighth of it is what is broadcast.
BITMAP_BITS = 1 << 27
CACHE_SCHEMA = "content_digest binary, tokenizer_digest binary, n_tokens long"


class ChunkCounter:
    """Counts tokens of texts chunk by chunk, for tokenizers whose pre-tokenizer drops white space: the tokens of a
    text are then those of its chunks between ASCII blanks, one after the other."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        chunks = [t.encode().split() for t in texts]
        known, old = self.young, self.old
        missing = {c for own in chunks for c in own if c not in known}
        here: dict[bytes, int] = {}
        for c in list(missing):
            if (n := old.get(c)) is not None:
                here[c] = n
                missing.discard(c)
        new = list(missing)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            encoded = self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)
            here.update(zip(part, map(len, encoded), strict=True))
        out = [sum([known[c] if c in known else here[c] for c in own]) for own in chunks]
        known.update((c, n) for c, n in here.items() if len(c) <= 64)
        if len(known) > MEMO:
            self.old, self.young = known, {}
        return out


class TextCounter:
    """Counts tokens of whole texts with sentencepiece."""

    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode(texts, num_threads=1)]


class LibraryCounter:
    """Counts tokens of whole texts with the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_COUNTERS: dict[tuple[str, str], object] = {}


def drops_blanks(path: str) -> bool:
    """Whether the pre-tokenizer of a .json keeps only what matches a pattern without white space."""
    import json

    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    first = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and all(not t["lstrip"] and not t["rstrip"] and not any(map(str.isspace, t["content"])) for t in rules["added_tokens"])


def tokenizer_digest(path: str) -> bytes:
    """Of the tokenizer's file and of the version of the library that reads it."""
    import sentencepiece
    import tokenizers

    version = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(version.encode() + b"\x00" + f.read()).digest()


def normalise(text: Column, blanks_dropped: bool) -> Column:
    """Runs of ASCII white space become one blank and none is left at the ends, where the tokenizer drops them."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")) if blanks_dropped else text


def _encoder(spark: SparkSession, path: str) -> Callable[[list[str]], list[int]]:
    """A function for workers: the counts of texts by the tokenizer of a file that each of them has."""
    ship(spark)
    spark.sparkContext.addFile(path)
    name, kind = os.path.basename(path), "piece" if path.endswith(".model") else "chunk" if drops_blanks(path) else "text"

    def counts(texts: list[str]) -> list[int]:
        at = SparkFiles.get(name)
        if (kind, at) not in _COUNTERS:
            _COUNTERS[kind, at] = {"piece": TextCounter, "chunk": ChunkCounter, "text": LibraryCounter}[kind](at)
        return [n for i in range(0, len(texts), SLICE) for n in _COUNTERS[kind, at].count(texts[i : i + SLICE])]

    return counts


def _forget() -> None:
    """A worker that waits for its next task holds little."""
    _COUNTERS.clear()
    release()


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """content_digest and n_tokens of rows (content_digest, text)."""
    counts = _encoder(misses.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts(batch.column(1).to_pylist()), pa.int64())], names=["content_digest", "n_tokens"])
        _forget()

    return misses.select("content_digest", "text").mapInArrow(encode, "content_digest binary, n_tokens long")


def bitmap(marked: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits, set at the ``bit`` of each row of marked; parts of 4 KB are made by the tasks."""
    parts = marked.groupBy(F.shiftright("bit", 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def encode_in_place(rows: DataFrame, marked: np.ndarray, path: str) -> DataFrame:
    """rows (doc_id, n_bytes, content_digest, bit, text) with ``n_tokens`` and without a text where the bit isn't set, and
    with a null count and the text elsewhere."""
    counts, shared = _encoder(rows.sparkSession, path), rows.sparkSession.sparkContext.broadcast(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(3).to_numpy()
            alone = (shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 0
            texts = batch.column(4).to_pylist()
            made = iter(counts([t for t, a in zip(texts, alone, strict=True) if a]))
            n = pa.array([next(made) if a else None for a in alone], pa.int64())
            left = pa.array([None if a else t for t, a in zip(texts, alone, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], left, n], names=["doc_id", "n_bytes", "content_digest", "text", "n_tokens"])
        _forget()

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, content_digest binary, text string, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of every row of docs; counts that the cache lacks are encoded and appended to it."""
    spark = docs.sparkSession
    version = F.lit(tokenizer_digest(tokenizer_path))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.unhex(F.sha2(normalise(text, bool(drops_blanks(tokenizer_path))), 256))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("content_digest"), text.alias("text"))
    bit = F.pmod(F.xxhash64("content_digest"), F.lit(BITMAP_BITS))
    cache_path = cache_path or scratch(spark, "token-cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def cached() -> DataFrame:
        stored_counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == version)
        return stored_counts.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(counted: DataFrame) -> None:
        counted.select("content_digest", version.alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)

    digests = rows.groupBy("content_digest").agg(F.count(F.lit(1)).alias("n_rows")).join(cached(), "content_digest", "left")
    marked = digests.filter("n_rows > 1 or n_tokens is not null").select(bit.alias("bit"))
    passed = stored(encode_in_place(rows.select("doc_id", "n_bytes", "content_digest", bit.alias("bit"), "text"), bitmap(marked), tokenizer_path), "encoded-in-place")
    alone, rest = passed.filter("n_tokens is not null"), passed.filter("n_tokens is null")
    distinct = rest.groupBy("content_digest").agg(F.first("text").alias("text"))
    append(encode_misses(distinct.join(cached().select("content_digest"), "content_digest", "left_anti"), tokenizer_path))
    counts = stored(cached(), "token-counts")  # a plain table: both sides of the join can be split where copies pile up
    append(alone)
    found = rest.drop("n_tokens").join(counts, "content_digest")
    return alone.select("doc_id", "n_bytes", "n_tokens").unionByName(found.select("doc_id", "n_bytes", "n_tokens"))
