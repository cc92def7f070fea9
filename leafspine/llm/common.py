"""What the corpus operators share: the shared folder, lineage cuts and shipping the package to executors."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch, shared_dir, stored
from ..sources.shipping import ship as sources_ship

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "Positional", "drop_scratch", "partitions", "release", "scratch", "shared_dir", "ship", "stored", "table", "without"]

_SET: set[str] = set()
#: Arrow batches stay below this many rows and bytes, so that a batch of long texts stays small on both sides.
BATCH_ROWS, BATCH_BYTES = "2000", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, and keep Arrow batches small (once for an application)."""
    if sources_ship(spark) or spark.sparkContext.applicationId not in _SET:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        _SET.add(spark.sparkContext.applicationId)


def drop_scratch(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Positional:
    """A table under names that say nothing but the position (``rows``), so that no column of an operator's own can clash
    with one of the table's."""

    def __init__(self, table: DataFrame):
        self.names = table.columns
        self.rows = table.toDF(*[f"c{i}" for i in range(len(self.names))])

    def of(self, name: str) -> str:
        """What a column is called in rows; upper and lower case are one, as in Spark."""
        return f"c{[n.lower() for n in self.names].index(name.lower())}"

    def back(self, results: tuple[str, ...] = ()) -> list[Column]:
        """The columns under their own names, without those called like one of the results, which take their place."""
        taken = {r.lower() for r in results}
        return [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in taken]


def without(table: DataFrame, *results: str) -> DataFrame:
    """table without the columns that are called like one of the results, which take their place."""
    taken = {r.lower() for r in results}
    return table.select(*[F.col(f"`{c}`") for c in table.columns if c.lower() not in taken])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that is no longer used back to the system: Python workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
