"""Operator 6, MinHash near-dedup: fast similarity sketches, banding and exact verification.

Texts are lower-cased (A-Z) and cut into words at ``[\\x20\\x09-\\x0D]``; a document's set holds its distinct shingles
of ``width`` words (with fewer words, the whole sequence is one). Documents are linked if
``100 * intersection >= percent * union`` on the full sets; a component is what links connect.

1. Equal word sequences form one class, named by its smallest id, so copies are counted, not compared.
2. Each set gets a sketch of ``t`` coordinates: in round i < t every element is thrown into a hashed bin with a
   hashed value and a bin without a coordinate takes its least value; rounds t to 2t-1 throw all elements into bin
   i-t. So every coordinate is filled, and agreement of coordinates estimates the similarity with the concentration
   of one permutation per coordinate, at the cost of a few passes over the set.
3. Rows of ``r`` coordinates are bands; r is the largest with a chance below 1e-6 to miss a pair at the threshold.
4. In each bucket of a band all members are compared to the least one. Pairs whose sketches can't reach the
   threshold (5 standard deviations) or whose sizes can't are left out, the others are verified on full sets.
5. Buckets whose members are in one component then are finished: for any group of linked copies that is one
   comparison each. The members of other buckets are compared across components in blocks of bounded size, by sizes
   and sketches first, which gives the members that have a partner left; these are dealt again with their texts and
   verified on full sets inside the block. Only links leave it, and components are taken again.
   No bucket is capped and no pairs of a group are listed.

Intermediate tables are written to the shared folder. Nothing is collected to the driver but counts.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; rows that
repeat an id are one document; a row with a null id is linked with nothing, has a null component and is kept; an
empty table gives no rows; extra columns are kept by :func:`deduplicate`, whatever their names. Ids that are no
integers are taken as strings, and the smallest is the first in their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Positional, partitions, release, ship, stored

WIDTH, COORDINATES, BLOCK = 5, 125, 256
#: Shingle hashes that a worker remembers while it verifies pairs, 8 bytes each.
RECENT = 1_000_000
_EMPTY = np.uint64(2**64 - 1)
_ROUND_KEYS = np.array([xxhash.xxh3_64_intdigest(f"round {i}".encode()) for i in range(2 * COORDINATES)], dtype=np.uint64)
_BAND_KEYS = np.array([xxhash.xxh3_64_intdigest(f"band {i}".encode()) for i in range(COORDINATES)], dtype=np.uint64)


def rows_per_band(percent: int, t: int = COORDINATES, miss: float = 1e-6) -> int:
    """The most coordinates in a band such that a pair at the threshold is missed with a chance below miss."""
    s = percent / 100
    return max((r for r in range(1, 11) if (1 - s**r) ** (t // r) < miss), default=1)


def id_type(docs: DataFrame, id_col: str) -> str:
    """What ids are compared as."""
    return "long" if isinstance(docs.select(F.col(f"`{id_col}`")).schema[0].dataType, IntegralType) else "string"


def word_list(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], width: int = WIDTH) -> set[bytes]:
    if not words:
        return set()
    if len(words) < width:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _hashes(words: list[bytes], joined: bytes, width: int) -> np.ndarray:
    """The set of a text that has words, as sorted 64-bit hashes: of n shingles two share one with a chance of
    n * n / 2**65 (3e-8 for a million)."""
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(joined)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh3_64_intdigest
    return np.unique(np.array([h(joined[s:e]) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=False)], dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The t coordinates of a set of 64-bit hashes that isn't empty."""
    out = np.full(t, _EMPTY)
    n, i, bins = len(elements), 0, np.uint64(t)
    while i < t and (empty := out == _EMPTY).any():
        rounds = min(t - i, max(1, 512 // n))
        x = _mix(elements[None, :] ^ _ROUND_KEYS[i : i + rounds, None])
        where, value = ((x >> np.uint64(32)) * bins) >> np.uint64(32), (x << np.uint64(32)) | (x >> np.uint64(32))
        if rounds == 1:
            new = np.full(t, _EMPTY)
            np.minimum.at(new, where[0].astype(np.intp), value[0])
            out[empty] = new[empty]
        else:
            where, value, of = where.ravel().astype(np.intp), value.ravel(), np.repeat(np.arange(rounds), n)
            order = np.lexsort((value, of, where))
            first, at = np.unique(where[order], return_index=True)
            fresh = empty[first]
            out[first[fresh]] = value[order[at[fresh]]]
        i += rounds
    for j in np.flatnonzero(out == _EMPTY):
        out[j] = _mix(elements ^ _ROUND_KEYS[t + j]).min()
    return out


def bands(coordinates: np.ndarray, r: int) -> np.ndarray:
    """One hash for each band of r coordinates."""
    n = len(coordinates) // r
    out = _BAND_KEYS[:n].copy()
    for column in coordinates[: n * r].reshape(n, r).T:
        out = _mix(out ^ column)
    return out.view(np.int64)


def _least_matches(percent: int, t: int = COORDINATES) -> int:
    """Coordinates, of which 8 bits are kept, that agree in a pair at the threshold, less 5 standard deviations."""
    s = percent / 100
    s += (1 - s) / 256
    return math.floor(t * s - 5 * math.sqrt(t * s * (1 - s)))


def sketch_documents(docs: DataFrame, percent: int, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), class (digest of the words; null without words), bands and the short sketch of every row."""
    ship(docs.sparkSession)
    r, kind = rows_per_band(percent), id_type(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, classes, keys, short = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = word_list(text)
                if not words:
                    n.append(0)
                    for column in (classes, keys, short):
                        column.append(None)
                    continue
                joined = b" ".join(words)
                hashes = _hashes(words, joined, width)
                coordinates = sketch(hashes)
                n.append(len(hashes))
                classes.append(xxhash.xxh3_128_digest(joined))
                keys.append(bands(coordinates, r))
                short.append(coordinates.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())], names=["id", "n", "class", "bands", "short"])
        release()

    rows = docs.select(F.col(f"`{id_col}`").cast(kind).alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, class binary, bands array<long>, short binary")


def _pair_type(df: DataFrame, column: str) -> str:
    kind = dict(df.dtypes)[column]
    return f"a {kind}, b {kind}"


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, na, nb, sa, sb) whose sizes and sketches allow a link, as (a, b)."""
    least = _least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
                keep = (left == right).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    sized = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, _pair_type(sized, "a"))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("node").alias("b"), F.col("z").alias("zb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, recent, weight = zstandard.ZstdDecompressor(), {}, 0

        def of(z: bytes) -> np.ndarray:
            nonlocal weight
            if z not in recent:
                joined = unzip.decompress(z)
                recent[z] = _hashes(joined.split(), joined, width)
                weight += len(recent[z])
                while weight > RECENT and len(recent) > 2:
                    weight -= len(recent.pop(next(iter(recent))))
            return recent[z]

        for batch in batches:
            keep = []
            for za, zb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = of(za), of(zb)
                both = int(_shared_counts(x, [y])[0])
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        recent.clear()
        release()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(run, _pair_type(pairs, "a")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) of every node that has a link, by alternating large and
    small stars: each step hangs neighbours on the smallest one known, until nothing changes."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        before, seen = seen, _state(edges)
        if seen == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _state(edges: DataFrame) -> Row:
    """What a set of edges is told by: their number and two 64-bit sums over all of them, whatever their order."""
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()


def _shared_counts(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of each of the other sets lie in a set of sorted hashes."""
    flat = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def _cells(members: DataFrame) -> DataFrame:
    """The rows of members (bucket, k, node, ...), each in the cells of its block: a bucket is dealt into k blocks, and
    each pair of blocks is a cell."""
    dealt = members.withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cell = F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j"))
    dealt = dealt.withColumns({"cell": cell, "second": F.col("i") > F.col("j"), "own": F.col("i") == F.col("j")}).drop("i", "j", "k")
    return dealt.repartition(partitions(members.sparkSession), "cell").sortWithinPartitions("cell", "second", "node")


def _compared(dealt: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs of rows of a cell (bucket, band, node, label, n, short, bands) from two components, each in its first common
    band alone, whose sizes and sketches allow a link. With texts (z): the linked ones, as (a, b), decided on the full
    sets. Without: (bucket, node) of the rows that have such a partner, so at most one record a row leaves a cell."""
    least, exact, kind = _least_matches(percent), "z" in dealt.columns, dict(dealt.dtypes)["node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        unzip = zstandard.ZstdDecompressor()

        def compare(t: pa.Table) -> list[tuple[int, int]]:
            n = t.column("n").to_numpy()
            label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            if not label.any():
                return []
            second, band, own = t.column("second").to_numpy(), t.column("band")[0].as_py(), t.column("own")[0].as_py()
            short = np.frombuffer(b"".join(t.column("short").to_pylist()), dtype=np.uint8).reshape(len(n), -1)
            keys = np.array(t.column("bands").to_pylist(), dtype=np.int64)
            sets: dict[int, np.ndarray] = {}

            def of(i: int) -> np.ndarray:
                if i not in sets:
                    joined = unzip.decompress(t.column("z")[i].as_py())
                    sets[i] = _hashes(joined.split(), joined, width)
                return sets[i]

            found = []
            for x in range(len(n)) if own else np.flatnonzero(~second):
                y = np.arange(x + 1, len(n)) if own else np.flatnonzero(second)
                y = y[(label[y] != label[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
                y = y[(short[y] == short[x]).sum(axis=1) >= least] if len(y) else y
                y = y[(keys[y] == keys[x]).argmax(axis=1) == band] if len(y) else y
                if len(y) and exact:
                    both = _shared_counts(of(int(x)), [of(int(i)) for i in y])
                    y = y[100 * both >= percent * (n[x] + n[y] - both)]
                found += [(int(x), int(i)) for i in y]
            return found if exact else [(i, i) for i in {i for pair in found for i in pair}]

        def finished(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            cell = t.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            if not last:
                held = t.slice(cuts[-2])
                cuts.pop()
            got = [(s + x, s + y) for s, e in zip(cuts, cuts[1:], strict=False) if e - s > 1 for x, y in compare(t.slice(s, e - s))]
            if got:
                first, node = (t.column(c).combine_chunks().take(pa.array([p[0] for p in got], pa.int64())) for c in ("node" if exact else "bucket", "node"))
                yield pa.RecordBatch.from_arrays([first, t.column("node").combine_chunks().take(pa.array([p[1] for p in got], pa.int64())) if exact else node], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None or not len(held) else pa.concat_tables([held, t])
            if len(t):
                yield from finished(t.combine_chunks(), False)
        if held is not None and len(held):
            yield from finished(held.combine_chunks(), True)
        release()

    if not exact:
        return dealt.mapInArrow(run, f"a long, b {kind}").toDF("bucket", "node").distinct()
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sized(members: DataFrame) -> DataFrame:
    """bucket and ``k``, the number of blocks of about BLOCK that its members make."""
    return members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))


def _across(members: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) across components in the same bucket; members: band, bucket, k, node, label. Sketches are compared
    first; texts travel for those rows alone that have a partner which sizes and sketches don't rule out."""
    likely = stored(_compared(_cells(members.join(sketches, "node")), percent, width), "likely")
    again = members.drop("k").join(likely, ["bucket", "node"]).join(stored(_sized(likely), "likely-sizes"), "bucket")
    return _compared(_cells(again.join(sketches, "node").join(texts, "node")), percent, width)


def link_documents(docs: DataFrame, percent: int = 85, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row of docs."""
    rows = stored(sketch_documents(docs, percent, width, id_col, text_col), "sketches")
    owned = rows.filter("id is not null and class is not null")
    reps = stored(owned.groupBy("class").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("short").alias("short")), "classes")
    buckets = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    # plain tables, here and below: both sides of a join by bucket can be split where a bucket is large
    shared = stored(buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last"), "shared")
    members = stored(buckets.join(shared, "bucket").select("band", "bucket", "node", "first"), "members")

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [pack.compress(b" ".join(word_list(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["node", "z"])

    kind = id_type(docs, id_col)
    texts = docs.select(F.col(f"`{id_col}`").cast(kind).alias("node"), F.col(f"`{text_col}`").alias("text")).filter("node is not null and text is not null")
    texts = stored(texts.mapInArrow(zipped, f"node {kind}, z binary").join(members.select("node").distinct(), "node", "left_semi"), "texts")
    left = reps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("short").alias("sa"))
    right = reps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("short").alias("sb"))
    stars = stored(members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    likely = _similar(stars.join(left, "a").join(right, "b"), percent).distinct()
    links = stored(_verified(likely, texts, percent, width), "links")
    labels = stored(components(links), "labels")

    labelled = members.join(labels, "node", "left").select("band", "bucket", "node", F.coalesce("label", "node").alias("label"))
    of_bucket = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    open_buckets = stored(of_bucket.filter("x < y").select("bucket", "k"), "open")
    still = stored(labelled.join(open_buckets, "bucket"), "still")
    links = links.unionByName(_across(still, reps.select("node", "n", "short", "bands"), texts, percent, width))
    # an id with several texts joins their classes
    class_nodes = reps.select("class", "node")
    several = owned.groupBy("id").agg(F.min(F.xxhash64("class")).alias("x"), F.max(F.xxhash64("class")).alias("y")).filter("x < y").select("id")
    joined = owned.join(several, "id").join(class_nodes, "class").select(F.col("node").alias("a"), F.col("id").alias("b"))
    labels = stored(components(links.unionByName(joined)), "labels")

    named = class_nodes.join(labels, "node", "left").select("class", F.coalesce("label", "node").alias("component"))
    out = rows.select("id", "n", "class").join(named, "class", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def deduplicate(docs: DataFrame, percent: int = 80, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document (the smallest id) of each component."""
    p = Positional(docs)
    gone = link_documents(docs, percent, width, id_col, text_col).filter("component_id < id").select(F.col("id").alias("gone")).distinct()
    return p.rows.join(gone, F.col(p.of(id_col)).cast(id_type(docs, id_col)) == F.col("gone"), "left_anti").select(*p.back())
