"""Log files as rows of lines, in batch and as a stream.

Lines end at \\n; one trailing \\r is cut off and any other \\r is data.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, r"\r$", "")


def read_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, line_no, line) with exact line numbers from 1; a file is read as a whole by one task."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("source"), "value")
    split = files.select("source", F.posexplode(F.split("value", "\n", -1)).alias("i", "line"), F.size(F.split("value", "\n", -1)).alias("n"))
    kept = split.where((F.col("i") < F.col("n") - 1) | (F.col("line") != ""))  # what a last line feed leaves
    return kept.select("source", (F.col("i") + 1).cast("bigint").alias("line_no"), _clean(F.col("line")).alias("line"))


def read_large_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, line_no, line) for files of any size: split among tasks, numbered by place in the file.

    line_no rises along a file, as splits and their rows do, but isn't dense.
    """
    rows = spark.read.option("lineSep", "\n").text(paths).select(F.input_file_name().alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    within = F.col("i").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select("source", (F.col("block") + within).alias("line_no"), _clean(F.col("value")).alias("line"))


def missing_paths(paths: list[str]) -> list[str]:
    """Local paths that can't be read; the others are processed all the same."""
    return [p for p in paths if "://" not in p and not os.access(p.removeprefix("file:"), os.R_OK)]


def follow_logs(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of (source, line) from files that come into a folder; each file must appear whole."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder).select(F.input_file_name().alias("source"), _clean(F.col("value")).alias("line"))
