"""From log lines to messages and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagstream.functions import fields as fx

#: Lines of one source that are numbered together; bounds the rows of a numbering task.
BLOCK = 1 << 16


def extract_messages(lines: DataFrame, anchored: bool = False) -> DataFrame:
    """(source, line_no, msg_idx, raw): each message in each line of (source, line_no, line). No shuffle."""
    found = lines.where(F.contains(F.col("line"), F.lit("8=FIX"))).select("source", "line_no", F.posexplode(fx.messages(F.col("line"), anchored)).alias("msg_idx", "raw"))
    return found


def lines_without_messages(lines: DataFrame, anchored: bool = False) -> DataFrame:
    """The lines that pass through as they are."""
    return lines.where(F.col("line").isNotNull() & (F.size(fx.messages(F.col("line"), anchored)) == 0))


def number_messages(messages: DataFrame) -> DataFrame:
    """`messages` and seq, their number from 1 by source, line and place in the line.

    Blocks of lines are counted, the counts of blocks summed up, and rows numbered within a block, so no
    task sees more than a block's rows; only the list of blocks is put in one order.
    """
    blocked = messages.withColumn("_block", (F.col("line_no") / BLOCK).cast("bigint"))
    counts = blocked.groupBy("source", "_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("source", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("source", "_block").orderBy("line_no", "msg_idx")
    ranked = blocked.withColumn("_rank", F.row_number().over(within))
    return ranked.join(offsets, ["source", "_block"]).withColumn("seq", F.col("_offset") + F.col("_rank")).drop("_block", "_offset", "_rank")


def with_fields(messages: DataFrame) -> DataFrame:
    """`messages` and fields, the tokenised form."""
    return messages.withColumn("fields", fx.fields(F.col("raw")))


def explode_fields(messages: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, tag, value): one row a field."""
    df = messages if "fields" in messages.columns else with_fields(messages)
    return df.select(*keys, F.explode("fields").alias("f")).select(*keys, "f.pos", "f.tag", "f.value")
