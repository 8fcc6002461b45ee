"""A training-data pipeline over `documents`: each stage applies one operator to all its predecessor kept.

1. language_id: documents whose language is rejected (no text, no letter, too far from every centroid) go.
2. exact_dedup: of equal texts, the row with the largest doc_id stays.
3. near_dedup: of rows that link by five-word shingles alike in 0.8 or more, one with the smallest doc_id stays; null ids come last.
4. decontamination: documents that hold a window of a benchmark item go.
5. packing: what is left becomes sequences of at most 1024 tokens, one row a piece.

Stages 1 to 4 return the columns of `documents`. A document with a null id is judged like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagstream.llm import decontam, exact_dedup, langid, ngram_join, packing
from tagstream.llm.common import materialize, third


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(third() != 1))
    return langid.identify(docs, model).where(~F.col("lang_rejected")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are told apart by a key of their own, written down first: ids can be null or repeat
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = ngram_join.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), k=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    linked = groups.join(groups.where("_row <> _group").select("_group").distinct(), "_group", "left_semi")
    named = materialize(linked.join(rows.select("_row", "doc_id"), "_row"), "linked")
    stays = named.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("least")).select(F.col("least._row").alias("_row"))
    gone = named.join(stays, "_row", "left_anti").select("_row")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, length=1024)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontamination), ("packing", pack)]

#: SQL can express neither centroids nor tokenizers: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
