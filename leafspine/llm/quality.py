"""Operator 3, quality classifier: an interpolated modified Kneser-Ney model of character 5-grams, trained on trusted
text; sharded count joins give each document's perplexity, and quantiles of each language give the thresholds.

Characters are classes: code points below ``PLAIN`` (Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Syriac, N'Ko) are
themselves, all others share the rest of the ``CLASSES`` by hash, about eleven Han characters a class. A 5-gram is a
60-bit key. Keys are dealt to shards by the last two characters of their context, so a shard holds all counts that
the orders 5, 4 and 3 of its keys need; orders 2 and 1 are one sparse table of the bigrams that occur, which is
broadcast: at most CLASSES * CLASSES entries of 8 bytes (134 MB), some thousands for an alphabet.

1. One pass over the texts, in blocks of about ``BLOCK_CHARS``: each block gives the distinct keys it needs scored
   and, of its trusted texts, keys with counts, by shard. Text isn't shuffled for this; what is passed on grows with
   the distinct keys of the blocks.
2. Counts are merged by shard (in two steps, so that no task gathers those of all blocks at once) and give
   continuation counts and, per order, the discounts.
3. Keys asked for join the counts of their shard and get probabilities, which return to their blocks.
4. The texts of each block meet the probabilities of its keys: the mean of log2 p is the perplexity's logarithm.
   This is done first for the held-out documents alone, which give the thresholds, then for all.

Trusted are documents with quality 1 and toxic 0 in labels. Every ``FOLDS``-th of them (by hash) is held out of the
training and gives the quantiles, so thresholds rest on text the model hasn't seen; all others are trained on. A
document is rejected if its bits a character, shrunk towards its language's median by ``PRIOR_CHARS`` characters, lie
over the quantile ``HIGH`` of its language's held-out documents, to which ``WIDE_BITS * PRIOR_DOCS / (n + PRIOR_DOCS)``
is added: the uncertainty of a quantile of n documents, by one law at every size. Other languages have no say in it.
Quantiles are read off histograms of ``BINS`` bins a bit, which merge in any order to the same result.

Defined results: a null or empty text has no characters, null bits and is kept (nothing speaks against it); a null
language is a language; documents of a language of which none is held out are kept, too; without labels nothing is trusted and everything is kept; labels of unknown ids are ignored,
a document with several labels is trusted if all are; rows that repeat an id are scored each; an empty table gives
no rows; extra columns are kept, those named like a result of :func:`classify` give way to it. Ids of docs and labels
that differ in type are compared as docs have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Positional, partitions, release, ship, stored

ORDER, BITS, CLASSES, PLAIN = 5, 12, 4096, 2304
BLOCK_CHARS, CHUNK_CHARS, SHARDS = 12_000_000, 1_000_000, 96
FOLDS, PRIOR_CHARS, HIGH, BINS = 5, 100.0, 0.99, 100
WIDE_BITS, PRIOR_DOCS = 2.0, 1.0
#: Log probabilities travel as 16-bit steps of 1/2048 bit.
STEP = 2048
RESULTS = ("__trust", "__chars", "__bits", "__most", "__keep")
#: The most trusted ids that are broadcast (16 bytes each); beyond it they join by a shuffle.
MAX_BROADCAST_IDS = 2_000_000
_LOW2 = np.uint64((1 << (2 * BITS)) - 1)


def classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    far = c >= PLAIN
    if far.any():
        c[far] = np.uint64(PLAIN) + ((c[far] * np.uint64(2654435761)) >> np.uint64(7)) % np.uint64(CLASSES - PLAIN)
    return c


def keys_of(text: str) -> np.ndarray:
    """The key of the 5-gram that ends at each character; four characters of class 1 stand before the first."""
    c = np.concatenate((np.ones(ORDER - 1, dtype=np.uint64), classes(text)))
    n = len(c) - ORDER + 1
    key = np.zeros(n, dtype=np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(BITS)) | c[i : i + n]
    return key


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    x = (keys >> np.uint64(BITS)) & _LOW2
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(shards)).astype(np.int64)


def _pack(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight side by side compress well."""
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with summed counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)


def _lower(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of an order in sorted keys of the next order, with their continuation counts."""
    return np.unique(keys & np.uint64((1 << (order * BITS)) - 1), return_counts=True)


def discounts(n: list[float]) -> list[float]:
    """D1, D2 and D3+ of an order from the numbers of grams that were counted once to four times."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in n)
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), m - 0.05) for m, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _level(keys: np.ndarray, counts: np.ndarray, d: list[float], asked: np.ndarray, below: np.ndarray) -> np.ndarray:
    """p of the asked grams of an order, given p of their suffixes."""
    if not len(keys):
        return below
    context, start = np.unique(keys >> np.uint64(BITS), return_index=True)
    disc = np.array([0.0, *d])[np.minimum(counts, 3)]
    total, left = np.add.reduceat(counts.astype(float), start), np.add.reduceat(disc, start)
    at = np.minimum(np.searchsorted(context, h := asked >> np.uint64(BITS)), len(context) - 1)
    known = context[at] == h
    i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    own = np.where(keys[i] == asked, counts[i] - disc[i], 0.0)
    return np.where(known, (own + left[at] * below) / total[at], below)


class Bigrams:
    """p(second | first) of classes, from the sorted keys of the bigrams that occur and their continuation counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.p = keys.astype(np.uint32), np.zeros(0, np.float32)
        #: Of a bigram that doesn't occur: the weight of its first class times p of its second.
        self.back, self.single = np.ones(CLASSES), np.full(CLASSES, 1 / CLASSES)
        if not len(keys):
            return
        ones, n1 = _lower(keys, 1)
        d1, d2 = (discounts([np.sum(c == i) for i in range(1, 5)]) for c in (n1, counts))
        taken = np.array([0.0, *d1])[np.minimum(n1, 3)]
        self.single = np.full(CLASSES, taken.sum() / n1.sum() / CLASSES)
        self.single[ones.astype(np.int64)] += (n1 - taken) / n1.sum()
        first, second = (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64(CLASSES - 1)).astype(np.int64)
        disc = np.array([0.0, *d2])[np.minimum(counts, 3)]
        total, left = np.bincount(first, counts, CLASSES), np.bincount(first, disc, CLASSES)
        seen = total > 0
        self.back[seen] = left[seen] / total[seen]
        self.p = ((counts - disc) / total[first] + self.back[first] * self.single[second]).astype(np.float32)

    def of(self, asked: np.ndarray) -> np.ndarray:
        """p of bigram keys."""
        p = self.back[(asked >> np.uint64(BITS)).astype(np.int64)] * self.single[(asked & np.uint64(CLASSES - 1)).astype(np.int64)]
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, asked.astype(np.uint32)), len(self.keys) - 1)
            known = self.keys[i] == asked
            p[known] = self.p[i[known]]
        return p


def probabilities(asked: np.ndarray, keys: np.ndarray, counts: np.ndarray, d: dict[int, list[float]], pairs: Bigrams) -> np.ndarray:
    """p of the asked 5-grams from the counts of their shard."""
    p = pairs.of(asked & _LOW2)
    four, c4 = _lower(keys, 4)
    three, c3 = _lower(four, 3)
    for order, k, c in ((3, three, c3), (4, four, c4), (5, keys, counts)):
        p = _level(k, c, d[order], asked & np.uint64((1 << (order * BITS)) - 1), p)
    return p


def _blocks(texts: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, pa.Table]]:
    """Chunks of rows with the block that each is in: a block ends when it has BLOCK_CHARS; both passes cut alike."""
    partition, block, size = TaskContext.get().partitionId(), 0, 0
    for batch in texts:
        rows, start, chars = pa.Table.from_batches([batch]), 0, 0
        lengths = [len(t or "") for t in rows.column(at).to_pylist()]
        for i, n in enumerate(lengths):
            chars += n
            if chars >= CHUNK_CHARS or i + 1 == len(lengths):
                yield (partition << 24) | block, rows.slice(start, i + 1 - start)
                size, start, chars = size + chars, i + 1, 0
                if size >= BLOCK_CHARS:
                    block, size = block + 1, 0


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with ``__trust``: 1 in training, 2 held out, 0 not trusted."""
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    good = good.filter("good").select(F.col("doc_id").try_cast(dict(docs.dtypes)[id_col]).alias("__good")).filter("__good is not null").distinct()
    small = good.count() <= MAX_BROADCAST_IDS
    joined = docs.join(F.broadcast(good) if small else good, F.col(f"`{id_col}`") == F.col("__good"), "left")
    trust = F.when(F.col("__good").isNull(), 0).when(F.pmod(F.xxhash64("__good"), F.lit(FOLDS)) == 0, 2).otherwise(1)
    out = joined.withColumn("__trust", trust).drop("__good")
    return out if small else stored(out, "flagged")  # both passes must meet the rows in the same order


def gather(rows: DataFrame, text_col: str, shards: int, subs: int) -> DataFrame:
    """The first pass: for each block and shard the keys asked for (kind 0) and counted (kind 1)."""
    at, trust_at = rows.columns.index(text_col), rows.columns.index("__trust")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: int, kind: int, keys: np.ndarray, counts: np.ndarray | None) -> pa.RecordBatch:
            of = _shard(keys, shards)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(shards + 1))
            own = [(s, order[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(own), pa.int32()), pa.array([s for s, _ in own], pa.int32()), pa.array([(block >> 24) % subs] * len(own), pa.int32()), pa.array([block] * len(own), pa.int64()),
                 pa.array([_pack_keys(keys[i]) for _, i in own], pa.binary()), pa.array([b"" if counts is None else _pack(counts[i].astype(np.uint32)) for _, i in own], pa.binary())],
                names=["kind", "shard", "sub", "block", "keys", "counts"],
            )

        now, asked, counted = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if asked:
                yield told(now, 0, np.unique(np.concatenate(asked)), None)
            if counted:
                yield told(now, 1, *merged(counted))
            asked.clear()
            counted.clear()

        for block, chunk in _blocks(batches, at):
            if block != now:
                yield from flush()
                now = block
            texts, trust = chunk.column(at).to_pylist(), chunk.column(trust_at).to_pylist()
            keys = [keys_of(t) for t in texts if t]
            if keys:
                asked.append(np.unique(np.concatenate(keys)))
            if train := [k for k, f in zip(keys, [f for t, f in zip(texts, trust, strict=True) if t], strict=True) if f == 1]:
                counted.append(np.unique(np.concatenate(train), return_counts=True))
            for held in (asked, counted):
                if len(held) >= 12:
                    held[:] = [np.unique(np.concatenate(held))] if held is asked else [merged(held)]
        yield from flush()
        release()

    return rows.mapInArrow(run, "kind int, shard int, sub int, block long, keys binary, counts binary")


def _merge_rows(t: pa.Table) -> pa.Table:
    keys, counts = merged([(_unpack_keys(k), _unpack(c, np.uint32).astype(np.int64)) for k, c in zip(t.column("keys").to_pylist(), t.column("counts").to_pylist(), strict=True)])
    return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "keys": pa.array([_pack_keys(keys)], pa.binary()), "counts": pa.array([_pack(counts.astype(np.uint32))], pa.binary())})


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, what, n): numbers of grams counted once to four times (orders 3 to 5), and of order 2 the bigrams
    with their continuation counts in this shard."""
    for batch in batches:
        for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            keys, counts = _unpack_keys(k), _unpack(c, np.uint32).astype(np.int64)
            four, c4 = _lower(keys, 4)
            three, c3 = _lower(four, 3)
            two, c2 = _lower(three, 2)
            rows = [(order, i, int(np.sum(n == i))) for order, n in ((5, counts), (4, c4), (3, c3)) for i in range(1, 5)]
            rows += [(2, int(g), int(n)) for g, n in zip(two, c2, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["order", "what", "n"])


def answers_for(rows: DataFrame, text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """block, keys and bits (-log2 p) of every key in the texts of rows (with ``__trust``), from the trusted ones."""
    spark = rows.sparkSession
    ship(spark)
    subs = max(1, partitions(spark) // 64)  # groups of blocks, so that no task holds the requests of all
    told = stored(gather(rows, text_col, shards, subs), "grams")
    counts = told.filter("kind = 1").select("shard", "sub", "keys", "counts")
    if subs > 1:
        counts = counts.groupBy("shard", "sub").applyInArrow(_merge_rows, "shard int, keys binary, counts binary")
    model = stored(counts.select("shard", "keys", "counts").groupBy("shard").applyInArrow(_merge_rows, "shard int, keys binary, counts binary"), "model")
    found = model.mapInArrow(_statistics, "order int, what long, n long").groupBy("order", "what").agg(F.sum("n").alias("n")).toPandas()  # at most CLASSES**2 + 12 rows
    d = {k: discounts([found[(found.order == k) & (found.what == i)].n.sum() for i in range(1, 5)]) for k in (3, 4, 5)}
    two = found[found.order == 2].sort_values("what")
    shared = spark.sparkContext.broadcast((d, Bigrams(two.what.to_numpy(dtype=np.uint64), two.n.to_numpy(dtype=np.int64))))

    def answer(asks: pa.Table, counted: pa.Table) -> pa.Table:
        d, pairs = shared.value
        keys, n = (np.zeros(0, np.uint64), np.zeros(0, np.int64)) if not len(counted) else (_unpack_keys(counted.column("keys")[0].as_py()), _unpack(counted.column("counts")[0].as_py(), np.uint32).astype(np.int64))
        out = []
        for k in asks.column("keys").to_pylist():
            p = probabilities(_unpack_keys(k), keys, n, d, pairs)
            out.append(_pack(np.minimum(np.rint(-np.log2(np.maximum(p, 1e-9)) * STEP), 65535).astype(np.uint16)))
        return pa.table({"block": asks.column("block"), "keys": asks.column("keys"), "bits": pa.array(out, pa.binary())})

    by_sub = model.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))))
    asks = told.filter("kind = 0").select("shard", "sub", "block", "keys")
    answers = asks.groupBy("shard", "sub").cogroup(by_sub.groupBy("shard", "sub")).applyInArrow(answer, "block long, keys binary, bits binary")
    return stored(answers, "answers")


def score(rows: DataFrame, answers: DataFrame, text_col: str = "text", held_out: list[str] | None = None) -> DataFrame:
    """rows with ``__chars`` and ``__bits``: characters, and bits a character (null without). held_out: only the rows
    held out, with these columns; the blocks are cut from all rows nevertheless."""
    at = rows.columns.index(text_col)
    kept = rows.columns if held_out is None else list(dict.fromkeys([*held_out, text_col, "__trust"]))
    text_at = kept.index(text_col)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, chunk in _blocks(batches, at):
            if held_out is not None:
                chunk = chunk.select(kept)
                chunk = chunk.filter(pa.array([t == 2 for t in chunk.column("__trust").to_pylist()]))
                if not len(chunk):
                    continue
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, chunk.schema) as w:
                w.write_table(chunk)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zstandard.compress(sink.getvalue().to_pybytes(), 3)], pa.binary())], names=["block", "rows"])

    def apply(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint64), *map(_unpack_keys, answers.column("keys").to_pylist())])
        bits = np.concatenate([np.zeros(0, np.uint16), *(_unpack(b, np.uint16) for b in answers.column("bits").to_pylist())])
        order = np.argsort(keys)
        keys, bits = keys[order], bits[order].astype(np.int64)
        out = []
        for data in chunks.column("rows").to_pylist():
            t = pa.ipc.open_stream(zstandard.decompress(data)).read_all()
            n, sums = [], []
            for text in t.column(text_at).to_pylist():
                if text:
                    k = keys_of(text)
                    i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    if not np.array_equal(keys[i], k):
                        raise RuntimeError("the rows of a block changed between the passes")
                    sums.append(int(bits[i].sum()) / STEP / len(k))
                else:
                    sums.append(None)
                n.append(len(text or ""))
            out.append(t.append_column("__chars", pa.array(n, pa.int64())).append_column("__bits", pa.array(sums, pa.float64())))
        release()
        return pa.concat_tables(out) if out else empty

    fields = [f for c in kept for f in rows.schema.fields if f.name == c]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    empty = pa.Table.from_batches([], schema=pa.schema([*to_arrow_schema(rows.select(*[F.col(f"`{c}`") for c in kept]).schema), ("__chars", pa.int64()), ("__bits", pa.float64())]))
    texts = rows.mapInArrow(packed, "block long, rows binary")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, f"{schema}, __chars long, __bits double")


def thresholds(scored: DataFrame, lang_col: str = "lang") -> DataFrame:
    """``__lang``, ``__mid`` and ``__most`` bits a character, from histograms of the held-out trusted
    documents of each language that has any."""
    bins = scored.filter("__trust = 2 and __bits is not null").select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"), F.floor(F.col("__bits") * BINS).alias("bin"))
    bins = bins.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang")
    ranked = bins.withColumns({"upto": F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "of": F.sum("n").over(own)})

    def at(q: float):
        return (F.min(F.when(F.col("upto") >= F.col("of") * q, F.col("bin"))) + 0.5) / BINS

    made = ranked.groupBy("lang").agg(at(0.5).alias("mid"), at(HIGH).alias("high"), F.max("of").alias("of"))
    wider = F.lit(WIDE_BITS * PRIOR_DOCS) / (F.col("of") + PRIOR_DOCS)
    return made.select(F.col("lang").alias("__lang"), F.col("mid").alias("__mid"), (F.col("high") + wider).alias("__most"))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs, whose columns must not be named like those added: RESULTS."""
    rows = flagged(docs, labels, id_col)
    answers = answers_for(rows, text_col)
    limits = stored(thresholds(score(rows, answers, text_col, held_out=[lang_col]), lang_col), "limits")
    out = score(rows, answers, text_col).withColumn("__key", F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")))
    out = out.join(F.broadcast(limits), F.col("__key") == F.col("__lang"), "left")  # a row a language
    shrunk = (F.col("__bits") * F.col("__chars") + F.col("__mid") * PRIOR_CHARS) / (F.col("__chars") + PRIOR_CHARS)
    return out.withColumn("__keep", F.coalesce(shrunk <= F.col("__most"), F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with ``__trust``, ``__chars``, ``__bits``, ``__most`` and ``__keep``."""
    p = Positional(docs)
    return scored(p.rows, labels, p.of(id_col), p.of(text_col), p.of(lang_col)).select(*p.back(RESULTS), *RESULTS)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that aren't rejected, with the columns of docs and no others."""
    p = Positional(docs)
    return scored(p.rows, labels, p.of(id_col), p.of(text_col), p.of(lang_col)).filter("__keep").select(*p.back())
