"""python -m leafspine IN OUT: the files of a folder (or one file) as a Markdown file for each chapter, in OUT/<name>/.

The name is the file's without its extension; files that share it get a digest of their path behind it.

python -m leafspine --prompts FOLDER: a prompt file in each numbered folder of chapter files below FOLDER.

OUT and FOLDER are local paths, or URIs of a store that all machines see."""

from __future__ import annotations

import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import prompt, render
from .plans.reading import Reading
from .sources import parse


def folders(files: DataFrame) -> DataFrame:
    """path and ``doc_id``, the name of the folder that its chapters go to; no two paths share one."""
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    named = files.select("path").distinct().withColumn("stem", stem)
    shared = named.groupBy("stem").agg((F.count(F.lit(1)) > 1).alias("shared"))
    unique = F.when(F.col("shared"), F.concat("stem", F.lit("-"), F.substr(F.sha2("path", 256), F.lit(1), F.lit(16)))).otherwise(F.col("stem"))
    return named.join(shared, "stem").select("path", unique.alias("doc_id"))


def write_prompts(spark: SparkSession, folder: str) -> int:
    """The number of prompt files written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    made = prompt.prompts_of_folders(parse.decoded(files, ("utf-8",)).filter("text is not null").select("path", F.col("text").alias("content")))
    rows = made.select(F.substr("folder", F.lit(len(base) + 2)).alias("folder"), "file_name", F.col("prompt").alias("text"))
    return render.write_files(rows, folder).count()


def main(args: list[str]) -> int:
    if len(args) != 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("leafspine").getOrCreate()
    if args[0] == "--prompts":
        n = write_prompts(spark, args[1])
        print(f"{n} prompt files")
        return 0 if n else 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args[0])
    made = Reading(files).markdown(datetime.now().strftime("%Y-%m-%d %H:%M"))
    n = render.write_markdown(made.join(folders(files), "path"), args[1]).count()
    print(f"{n} chapters")
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
