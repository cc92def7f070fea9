"""Documents as they arrive: a stream of files, each whole, to chapters. An extension; every micro-batch is an ordinary
batch plan, so no state is kept and nothing waits for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dispatch, txt
from ..sources import parse


def file_stream(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(path)


def text_chapters(files: DataFrame) -> DataFrame:
    """path, chapter_index, title, level, word_count, paragraph_count of the plain-text files among files."""
    texts = parse.decoded(files.filter(dispatch.reader("path") == "txt"))
    lines = txt.split_lines(texts.filter("text is not null"), "text", "path")
    return txt.chapters(txt.blocks(lines)).withColumnRenamed("doc_id", "path")


def chapter_stream(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the chapters of each batch to ``out/batch=<id>``; a batch that is run again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        text_chapters(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
