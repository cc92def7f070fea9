"""A corpus pipeline: quality, line dedup, near-dedup, decontamination and tokenisation, each stage on what its
predecessor kept. ``STAGES`` lists the stages; :func:`run` applies them to documents, with each stage's rows written
as Parquet in the shared folder and read again for the next.

All but the last stage return the columns of documents. Nulls, empty texts, repeated rows and extra columns are
treated as the operators' docstrings say: documents without text pass every filter, rows that repeat an id stay or
go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspine.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from leafspine.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text of their language; the others go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents or more stay in one of them; n_chars follows the text."""
    return line_dedup.drop_lines(docs, min_docs=3, min_chars=20, length_col="n_chars" if "n_chars" in docs.columns else None)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.deduplicate(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents", n=10)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, their number, and whether they decode to the text."""
    decoded = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("__decoded")
    return decoded.select("doc_id", (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"), F.col("__ids").alias("ids"), same.alias("round_trip"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", tokenise),
]

#: SQL can express neither the language model nor sketches nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
