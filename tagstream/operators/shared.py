"""Tables in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With this, Spark deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own on one machine, an error on a cluster."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:/tmp/checkpoints/tagstream"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder for one table below the shared folder."""
    return f"{shared_dir(spark)}/tagstream/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind it go as soon as it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = path or work_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, component), component = smallest node.

    edges: columns a, b of one ordered type, in any order, loops and repeats allowed. Nodes without an
    edge don't appear. Alternates large-star and small-star steps; every step is an aggregation and an
    equi-join whose hot side can be split, and each round's edges are written to the shared folder. The
    driver sees two counts a round.
    """
    e = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("m", "a").alias("m"))
        large = both.join(low, F.col("a") == F.col("v")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.select(F.col("a").alias("v"), "m"), F.col("a") == F.col("v"))
        nxt = materialize(small.select(F.col("b").alias("x"), "m").where("x <> m").union(least.select("a", "m")).distinct().toDF("a", "b"), "cc")
        # done when every node has one edge, and no root has one
        stats = nxt.agg(F.count("*").alias("n"), F.countDistinct("a").alias("d")).first()
        e = nxt
        if stats.n == stats.d and not nxt.select(F.col("a").alias("r")).join(nxt.select(F.col("b").alias("r")), "r", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
