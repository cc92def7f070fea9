"""Operator 1, sharding: a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number 0..N-1, the keyed permutation sends the number to a place in the shuffled order,
and place p lies in shard ``p % n_shards`` at slot ``p // n_shards``. The law is ``rows``: shard sizes differ by at
most one row. Shard and slot are computable for a row number without reading data (:func:`place`), and
:func:`row_at` inverts them.

Defined results: a null text has size 1 (0 bytes plus 1) and checksum 0, like an empty one; repeated rows (same id
and text) take consecutive numbers and are interchangeable; null ids are ordinary keys; an empty table gives no rows;
extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

ROUNDS = 6
#: Copies of one row are listed in runs of this many, so no array grows with the number of copies.
RUN = 4096


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of x under a round key."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _sides(n: int) -> tuple[int, int]:
    a = max(1, int(np.ceil(np.sqrt(n))))
    return a, max(1, -(-n // a))


def _network(x: np.ndarray, n: int, seed: int, forward: bool) -> np.ndarray:
    """One pass over [0, a*b): the halves take turns adding a keyed function of the other half."""
    a, b = _sides(n)
    left, right = x // np.uint64(b), x % np.uint64(b)
    for r in range(ROUNDS) if forward else reversed(range(ROUNDS)):
        key = seed * ROUNDS + r
        if r % 2 == 0:
            d = _mix(right, key) % np.uint64(a)
            left = (left + (d if forward else np.uint64(a) - d)) % np.uint64(a)
        else:
            d = _mix(left, key) % np.uint64(b)
            right = (right + (d if forward else np.uint64(b) - d)) % np.uint64(b)
    return left * np.uint64(b) + right


def permute(rows: np.ndarray, n: int, seed: int = 0, forward: bool = True) -> np.ndarray:
    """The permutation of [0, n): whatever falls outside walks on along its cycle until it is inside."""
    out = np.asarray(rows, dtype=np.uint64)
    if len(out) == 0:
        return out
    out = _network(out, n, seed, forward)
    while (away := out >= np.uint64(n)).any():
        out[away] = _network(out[away], n, seed, forward)
    return out


def place(row: int, n: int, n_shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a global row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % n_shards, p // n_shards


def row_at(shard: int, slot: int, n: int, n_shards: int, seed: int = 0) -> int:
    """The global row number that lies in a slot of a shard."""
    return int(permute(np.array([slot * n_shards + shard]), n, seed, forward=False)[0])


def number_rows(df: DataFrame, keys: list[str], n_buckets: int = 4096) -> DataFrame:
    """Columns keys, ``row_no`` (0..N-1, each once) and ``n_rows`` (N), one row for each row of df.

    Equal rows are first counted (with partial sums before the shuffle), so a row that is repeated often is one
    record. Keys are hashed to n_buckets; the counts of the buckets, n_buckets rows whatever the input, give each
    bucket its first number, and a running sum inside a bucket gives the rest.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int"))
    whole = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("__b").agg(F.sum("__n").alias("__m"))
    starts = starts.select("__b", F.coalesce(F.sum("__m").over(whole), F.lit(0)).alias("__first"), F.sum("__m").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"))
    inside = Window.partitionBy("__b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("__at", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    numbered = numbered.join(F.broadcast(starts), "__b")  # at most n_buckets rows
    runs = numbered.withColumn("__run", F.explode(F.expr(f"sequence(0L, (__n - 1) div {RUN})")))
    copies = runs.withColumn("__copy", F.explode(F.expr(f"sequence(__run * {RUN}, least(__n, (__run + 1) * {RUN}) - 1)")))
    return copies.select(*keys, (F.col("__first") + F.col("__at") + F.col("__copy")).alias("row_no"), "n_rows")


def shard_rows(df: DataFrame, keys: list[str], n_shards: int, seed: int = 0, n_buckets: int = 4096) -> DataFrame:
    """keys, row_no, place, shard and slot for every row of df."""
    ship(df.sparkSession)
    numbered = number_rows(df, keys, n_buckets)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n = t.column("n_rows")[0].as_py() if len(t) else 1
            p = permute(t.column("row_no").to_numpy().astype(np.uint64), n, seed)
            t = t.drop_columns(["n_rows"])
            for name, col in (("place", p), ("shard", p % np.uint64(n_shards)), ("slot", p // np.uint64(n_shards))):
                t = t.append_column(name, pa.array(col.astype(np.int32 if name == "shard" else np.int64)))
            yield from t.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name != "n_rows")
    return numbered.mapInArrow(assign, f"{schema}, place long, shard int, slot long")


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The plan of the shards: id, size (UTF-8 bytes plus 1), text_crc32, row_no, place, shard and slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(keyed, ["doc_id", "size", "text_crc32"], n_shards, seed)
