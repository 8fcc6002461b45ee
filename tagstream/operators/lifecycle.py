"""Order lifecycle: which order a message belongs to, what happened to the order, and where it stands.

Input: messages (seq, fields, msg_type, is_admin) and optionally reason, the text of a message's violations.
Events are the projection of a message on what the lifecycle needs. Attributes of an order are first or last
non-null values by sequence, which partial aggregation computes before the shuffle; only the state path needs
an order's events in one order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.functions import fields as fx
from tagstream.operators import enrich
from tagstream.operators.shared import connected_components, materialize
from tagstream.sources.dictionary import Registry

#: Name and tag of the values an event carries.
TAGS = {
    "order_id": 37,
    "cl_ord_id": 11,
    "orig_cl_ord_id": 41,
    "symbol": 55,
    "side": 54,
    "order_qty": 38,
    "currency": 15,
    "last_qty": 32,
    "last_px": 31,
    "cum_qty": 14,
    "leaves_qty": 151,
    "avg_px": 6,
    "price": 44,
    "spot": 190,
    "ord_type": 40,
    "time_in_force": 59,
    "transact_time": 60,
    "sending_time": 52,
    "trade_date": 75,
    "settl_date": 64,
    "settl_date2": 193,
    "ord_status": 39,
    "exec_type": 150,
    "exec_ack": 1036,
    "text": 58,
}
#: Column, value and tag of the codes that a report spells out as their dictionary does.
DESCRIBED = {"msg_desc": ("msg_type", 35), "ord_type_desc": ("ord_type", 40), "tif_desc": ("time_in_force", 59)}
IDS = ["order_id", "cl_ord_id", "orig_cl_ord_id"]
#: What tells two events of one order apart, beside the reason.
FINGERPRINT = ["event_time", "msg_type", "exec_type", "ord_status", "state", "exec_ack", "cum_qty", "leaves_qty", "last_qty", "last_px", "avg_px", "text", "cl_ord_id", "orig_cl_ord_id"]


def events(messages: DataFrame, registry: Registry | None = None) -> DataFrame:
    """A row a message that isn't administrative: seq, msg_type, the values of TAGS (last one wins), event_time
    (60, else 52), state, reason, and the columns of DESCRIBED: by the message's dictionary with a registry, else null."""
    m = messages.where(~F.col("is_admin"))
    reason = F.col("reason") if "reason" in messages.columns else F.lit(None).cast("string")
    keys = ["dict_key", "fallback_key"] if registry else []
    df = m.select("seq", "msg_type", *keys, reason.alias("reason"), fx.tag_map(F.col("fields")).alias("_m"))
    df = df.select("seq", "msg_type", *keys, "reason", *[F.col("_m")[F.lit(t).cast("bigint")].alias(n) for n, t in TAGS.items()])
    for name, (code, tag) in DESCRIBED.items():
        df = enrich.with_description(df, registry, tag, code, name) if registry else df.withColumn(name, F.lit(None).cast("string"))
    df = df.drop(*keys)
    notice = F.col("msg_type") == "BN"
    return (
        df.withColumn("event_time", F.coalesce("transact_time", "sending_time"))
        .withColumn("state", fx.order_state(F.col("ord_status"), F.col("exec_type"), F.col("exec_ack"), F.col("leaves_qty")))
        .withColumn("spot", F.coalesce(F.when(notice, F.col("last_px")), F.col("spot")))
        .withColumn("exec_amount", F.when(notice, F.col("order_qty")))
        .withColumn("trade", F.coalesce(F.col("trade_date"), fx.date_part(F.col("transact_time")), F.col("transact_time")))
    )


# -- identity


def single_id(found: DataFrame, column: str = "order_id") -> DataFrame:
    """Events with order_key, where one id alone names the order: no state, no shuffle."""
    return found.where(F.col(column).isNotNull()).withColumn("order_key", F.col(column))


def _fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The messages of one component in sequence: the first registration of an id counts."""
    owner: dict[str, str] = {}
    table = pa.Table.from_batches(list(batches)).sort_by("seq")
    seqs, keys = [], []
    for seq, a, b, c in zip(*(table.column(n).to_pylist() for n in ("seq", *IDS)), strict=True):
        ids = [x for x in (a, b, c) if x]
        if not a and not b and (not c or c not in owner):
            continue  # no order flow
        found = next((owner[x] for x in (a, b, c) if x and x in owner), None) or a or b
        for x in ids:
            owner.setdefault(x, found)
        seqs.append(seq)
        keys.append(found)
    if seqs:
        yield pa.record_batch([pa.array(seqs, pa.int64()), pa.array(keys, pa.string())], names=["seq", "order_key"])


def resolve_identity(found: DataFrame, ignore_ids: tuple[str, ...] = ()) -> DataFrame:
    """Events with order_key. Ids of one message are looked up in the order 37, 11, 41; the first that is known
    names the order, and all ids that aren't known yet are registered for it. Orders are never merged.

    Ids that never meet in a message can't affect each other, so the exact fold runs by connected component of
    ids, each in its own task; a component is the messages of a chain of orders. Messages without an order
    are dropped. `ignore_ids` are ids that mean none.
    """
    clean = lambda c: F.when(~F.col(c).isin(*ignore_ids, ""), F.col(c)) if ignore_ids else F.when(F.col(c) != "", F.col(c))
    ids = materialize(found.select("seq", *[clean(c).alias(c) for c in IDS]), "ids")
    first = F.coalesce(*IDS)
    edges = ids.select(first.alias("a"), F.explode(F.array(*[F.col(c) for c in IDS])).alias("b"))
    parts = connected_components(edges).withColumnRenamed("node", "_node")
    keyed = ids.withColumn("_node", first).where("_node is not null").join(parts, "_node", "left").withColumn("component", F.coalesce("component", "_node")).drop("_node")
    owned = keyed.groupBy("component").applyInArrow(_fold, "seq bigint, order_key string")
    return found.join(owned, "seq")


# -- orders


def _last(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)


def _first(name: str) -> Column:
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)


ATTRIBUTES = [n for n in TAGS if n not in (*IDS, "transact_time", "sending_time", "trade_date", "text")] + ["exec_amount", "trade", "ord_type_desc", "tif_desc"]


def order_attributes(keyed: DataFrame) -> DataFrame:
    """A row an order: the first of each id, the last of each attribute, n_messages, first_seq, last_seq, has_notice, and
    settle: the last of 193, where there is one, else of 64."""
    df = keyed.groupBy("order_key").agg(
        *[_first(n) for n in IDS],
        *[_last(n) for n in ATTRIBUTES],
        F.count("*").alias("n_messages"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.max(F.col("msg_type") == "BN").alias("has_notice"),
    )
    return df.withColumn("settle", F.coalesce("settl_date2", "settl_date"))


def _when(order: Column | None = None) -> list[Column]:
    return [F.col("event_time").asc_nulls_last(), F.col("seq")]


def ordered_events(keyed: DataFrame) -> DataFrame:
    """Events without repeats (the first of each fingerprint), with their place among their order's events."""
    same = Window.partitionBy("order_key", *FINGERPRINT, "reason").orderBy(*_when())
    unique = keyed.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return unique.withColumn("place", F.row_number().over(Window.partitionBy("order_key").orderBy(*_when())))


def state_paths(keyed: DataFrame) -> DataFrame:
    """(order_key, states, flow, last_state): consecutive states that differ, in time order; a leading Unknown is
    left out of the flow of more than one."""
    w = Window.partitionBy("order_key").orderBy("place")
    changed = ordered_events(keyed).withColumn("_before", F.lag("state").over(w)).where(~F.col("state").eqNullSafe(F.col("_before")))
    path = changed.groupBy("order_key").agg(F.sort_array(F.collect_list(F.struct("place", "state"))).alias("_p")).withColumn("states", F.col("_p.state"))
    trimmed = F.when((F.size("states") > 1) & (F.get("states", F.lit(0)) == "Unknown"), F.slice("states", F.lit(2), F.size("states"))).otherwise(F.col("states"))
    return path.select("order_key", "states", F.array_join(trimmed, " -> ").alias("flow"), F.element_at("states", -1).alias("last_state"))


def order_records(keyed: DataFrame) -> DataFrame:
    """Attributes, path, is_terminal and display_id of each order."""
    df = order_attributes(keyed).join(state_paths(keyed), "order_key")
    done = F.col("last_state").isin(*fx.TERMINAL_STATES) | F.coalesce(F.col("exec_ack").isin(*fx.TERMINAL_ACKS), F.lit(False))
    return df.withColumn("is_terminal", done).withColumn("display_id", F.coalesce("order_id", "cl_ord_id", "order_key"))


def order_totals(records: DataFrame) -> DataFrame:
    """n_total, n_open, n_terminal."""
    return records.agg(F.count("*").alias("n_total"), F.count_if(~F.col("is_terminal")).alias("n_open"), F.count_if("is_terminal").alias("n_terminal"))


def summary_rows(records: DataFrame) -> DataFrame:
    """What a report shows of each order."""
    days = fx.business_days(F.col("trade"), F.col("settle"))
    return records.select(
        "display_id",
        "flow",
        F.when(F.col("side").isNotNull(), F.upper(fx.side_label(F.col("side")))).alias("side"),
        "symbol",
        "order_qty",
        "cum_qty",
        "leaves_qty",
        fx.price_with_currency(F.col("price"), F.col("currency")).alias("price"),
        "avg_px",
        F.col("trade").alias("trade_date"),
        days.alias("days"),
        fx.tenor(days).alias("tenor"),
        F.upper("tif_desc").alias("time_in_force"),
        F.upper("ord_type_desc").alias("ord_type"),
        F.when(F.col("settl_date2").isNotNull(), "SettlDate2").when(F.col("settl_date").isNotNull(), "SettlDate").otherwise("ValueDate").alias("settle_name"),
        "settle",
        F.when(F.col("has_notice"), F.col("spot")).alias("spot"),
        F.when(F.col("has_notice"), F.col("exec_amount")).alias("exec_amount"),
        "is_terminal",
        "last_seq",
    )


def timeline(keyed: DataFrame) -> DataFrame:
    """(order_key, place, event_time, cell, exec_type, ord_status, exec_ack, cum_leaves, last, avg_px, state, text) of each event.

    The cell is the message type's description, its code where there is none, and the ids. Codes have their labels, or
    themselves where they have none; what is missing is a dash.
    """
    dash = lambda name: F.coalesce(F.col(name), F.lit("-"))
    labelled = lambda labels, name: fx.label(labels, F.col(name), dash(name)).alias(name)
    ids = F.array_join(F.array("cl_ord_id", "orig_cl_ord_id"), ",")
    cell = F.concat(F.coalesce(F.col("msg_desc"), dash("msg_type")), F.when(ids != "", F.format_string(" [%s]", ids)).otherwise(""))
    invalid = F.concat(F.lit("Invalid: "), F.col("reason"))
    return ordered_events(keyed).select(
        "order_key",
        "place",
        "event_time",
        cell.alias("cell"),
        labelled(fx.EXEC_TYPE, "exec_type"),
        labelled(fx.ORDER_STATUS, "ord_status"),
        labelled(fx.EXEC_ACK, "exec_ack"),
        F.concat_ws("/", dash("cum_qty"), dash("leaves_qty")).alias("cum_leaves"),
        F.concat_ws("@", dash("last_qty"), dash("last_px")).alias("last"),
        dash("avg_px").alias("avg_px"),
        "state",
        F.array_join(F.array("text", invalid), " | ").alias("text"),
    )


def raw_messages(keyed: DataFrame, records: DataFrame, messages: DataFrame, delimiter: str = fx.SOH) -> DataFrame:
    """(order_key, place, seq, is_invalid, text): the messages of completed orders without repeats, in the order of
    their events, with the display delimiter. messages: seq, raw."""
    done = records.where("is_terminal").select("order_key")
    places = ordered_events(keyed.join(done, "order_key", "left_semi")).select("order_key", "place", "seq", F.col("reason").isNotNull().alias("is_invalid"))
    return places.join(messages.select("seq", fx.shown(F.col("raw"), delimiter).alias("text")), "seq").select("order_key", "place", "seq", "is_invalid", "text")


def report_order(records: DataFrame) -> DataFrame:
    """Completed orders in the order of completion, then open ones by key."""
    return records.orderBy(~F.col("is_terminal"), F.when(F.col("is_terminal"), F.col("last_seq")), "order_key")


def paged(records: DataFrame) -> DataFrame:
    """Orders by their last message and display id, with their place and the open and total orders up to it.

    Blocks of the sequence are summed up, and orders ranked within a block, so that no task ranks all orders.
    """
    block = 1 << 16
    df = records.withColumn("_b", (F.col("last_seq") / block).cast("bigint"))
    sums = df.groupBy("_b").agg(F.count("*").alias("_n"), F.count_if(~F.col("is_terminal")).alias("_o"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_o").over(before), F.lit(0)).alias("_o"))
    w = Window.partitionBy("_b").orderBy("last_seq", "display_id", "order_key")
    ranked = df.withColumn("_r", F.row_number().over(w)).withColumn("_p", F.count_if(~F.col("is_terminal")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.join(sums, "_b").withColumn("place", (F.col("_n") + F.col("_r")).cast("int")).withColumn("open_so_far", F.col("_o") + F.col("_p")).drop("_b", "_n", "_o", "_r", "_p")


def section_counts(records: DataFrame, messages: DataFrame) -> DataFrame:
    """(order_key, msg_type, n): how many messages of each type have come when an order had its last message.

    messages: seq, msg_type. Counts run within blocks of the sequence, and over blocks by their totals, so no
    type's messages meet in one task; the pairs made are orders times types.
    """
    block = 1 << 16
    m = messages.where("msg_type is not null").select("msg_type", "seq", (F.col("seq") / block).cast("bigint").alias("_b"))
    totals = m.groupBy("msg_type", "_b").agg(F.count("*").alias("_n"))
    types = F.array(*[F.lit(r["msg_type"]) for r in totals.select("msg_type").distinct().orderBy("msg_type").collect()])  # the kinds of messages there are
    last = records.select("order_key", F.col("last_seq").alias("seq"), (F.col("last_seq") / block).cast("bigint").alias("_b"))
    # a cumulative total for every block that has messages or orders
    asked_blocks = last.select("_b").distinct().select(F.explode(types.cast("array<string>")).alias("msg_type"), "_b", F.lit(0).cast("bigint").alias("_n"))
    grid = totals.unionByName(asked_blocks).groupBy("msg_type", "_b").agg(F.sum("_n").alias("_n"))
    before = grid.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("msg_type").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("msg_type", "_b", "_before")
    asked = last.join(before, "_b")
    rows = m.select("msg_type", "_b", "seq", F.lit(None).cast("string").alias("order_key"), F.lit(0).cast("bigint").alias("_before")).unionByName(asked.select("msg_type", "_b", "seq", "order_key", "_before"))
    upto = Window.partitionBy("msg_type", "_b").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("_in", F.count(F.when(F.col("order_key").isNull(), 1)).over(upto)).where("order_key is not null")
    return within.select("order_key", "msg_type", (F.col("_before") + F.col("_in")).alias("n")).where("n > 0")
