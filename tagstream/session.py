"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results; everything else is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Joins on keys that a third of all rows may have are split by the adaptive plan.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

TUNING = {
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to a session made elsewhere."""
    for k, v in (REQUIRED | ADAPTIVE).items():
        spark.conf.set(k, v)
    return spark


def make_session(master: str = "local[*]", app: str = "tagstream", shuffle_partitions: int | None = None, driver_memory: str = "8g", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster call `configure` on the session you have."""
    b = SparkSession.builder.master(master).appName(app).config("spark.driver.memory", driver_memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in (REQUIRED | ADAPTIVE | TUNING | conf).items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
