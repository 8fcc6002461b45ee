"""Synthetic logs from the driver's tables, and the same messages in DuckDB's dialect.

One template makes a message in both engines: a list of fields as SQL expressions. Differences between the
dialects are confined to `Dialect`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SOH = "chr(1)"


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def duck(self) -> bool:
        return self.name == "duckdb"

    def stamp(self, ts: str) -> str:
        return f"strftime({ts}, '%Y%m%d-%H:%M:%S')" if self.duck else f"date_format({ts}, 'yyyyMMdd-HH:mm:ss')"

    def day(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%d')" if self.duck else f"date_format({ts}, 'yyyy-MM-dd')"

    def text(self, value: str) -> str:
        return f"CAST({value} AS VARCHAR)" if self.duck else f"CAST({value} AS STRING)"

    def price(self, value: str) -> str:
        return self.text(f"CAST({value} AS DECIMAL(18,2))")

    def byte_sum(self, text: str) -> str:
        if self.duck:
            return f"CAST(list_sum(list_transform(string_split({text}, ''), lambda c: ascii(c))) AS BIGINT)"
        return f"aggregate(transform(split({text}, ''), c -> ascii(c)), 0L, (s, x) -> s + x)"

    def md5(self, text: str) -> str:
        return f"md5({text})"

    def body(self, fields: list[tuple[str, str]]) -> str:
        """Fields joined, each ended by the separator; a value of NULL leaves its field out."""
        parts = [f"CASE WHEN {value} IS NULL THEN '' ELSE concat('{tag}=', {value}, {SOH}) END" for tag, value in fields]
        return f"concat({', '.join(parts)})"

    def sealed(self, source: str, columns: str, body: str, begin: str = "'FIX.4.4'", extra_length: str = "0", extra_sum: str = "0") -> str:
        """SELECT columns, msg FROM source, with field 9 in front of the body and field 10 behind it."""
        return f"""
        SELECT {columns}, concat(head, '10=', lpad({self.text(f'(({self.byte_sum("head")}) + {extra_sum}) % 256')}, 3, '0'), {SOH}) AS msg
        FROM (SELECT *, concat('8=', {begin}, {SOH}, '9=', {self.text(f'length(body) + {extra_length}')}, {SOH}, body) AS head
              FROM (SELECT *, {body} AS body FROM ({source}) AS base) AS bodies) AS heads"""


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def order_fields(d: Dialect, corrupt: bool = False) -> list[tuple[str, str]]:
    """A NewOrderSingle for a row of `orders`; corrupted by the key's remainders if asked."""
    key = "o_orderkey"
    bad = lambda n, wrong, right: f"CASE WHEN {key} % {n} = 0 THEN {wrong} ELSE {right} END" if corrupt else right
    qty = d.text(f"({key} % 9 + 1) * 100")
    qty = bad(29, "'abc'", qty)
    kind = bad(17, "'Z'", "'2'")
    swap = f"{key} % 13 = 0" if corrupt else "1 = 0"
    return [
        ("35", "'D'"),
        ("49", "'BUY1'"),
        ("56", "'SELL1'"),
        ("34", d.text(key)),
        ("52", d.stamp("o_orderdate")),
        ("11", f"concat('CL', {d.text(key)})"),
        ("1", f"concat('ACC', {d.text('o_custkey')})"),
        ("21", "'1'"),
        ("55", f"concat('SYM', {d.text('o_custkey % 7')})"),
        ("54", bad(11, "NULL", d.text(f"{key} % 2 + 1"))),
        ("60", d.stamp("o_orderdate")),
        ("40", f"CASE WHEN {swap} THEN {kind} END"),
        ("38", qty),
        ("40", f"CASE WHEN NOT ({swap}) THEN {kind} END"),
        ("44", d.price("o_totalprice")),
        ("59", "CASE WHEN o_orderpriority LIKE '1%' THEN '3' WHEN o_orderpriority LIKE '2%' THEN '1' ELSE '0' END"),
        ("59", f"CASE WHEN {key} % 23 = 0 THEN '0' END" if corrupt else "NULL"),
        ("9999", f"CASE WHEN {key} % 31 = 0 THEN 'X' END" if corrupt else "NULL"),
    ]


def orders_sql(d: Dialect, corrupt: bool = False) -> str:
    """o_orderkey, o_custkey, o_orderdate, msg."""
    length = "CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END" if corrupt else "0"
    check = "CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END" if corrupt else "0"
    return d.sealed("SELECT * FROM orders", "o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderpriority", d.body(order_fields(d, corrupt)), extra_length=length, extra_sum=check)


def events_sql(d: Dialect) -> str:
    """event_id, user_id, ts, event_type, msg: a lifecycle of one order a user."""
    status = "CASE event_type WHEN 'click' THEN '0' WHEN 'view' THEN '1' WHEN 'purchase' THEN '2' WHEN 'error' THEN '8' END"
    fields = [
        ("35", "CASE WHEN event_type = 'signup' THEN 'D' ELSE '8' END"),
        ("49", "'BUY1'"),
        ("56", "'SELL1'"),
        ("34", d.text("event_id")),
        ("52", d.stamp("ts")),
        ("37", f"concat('ORD', {d.text('user_id')})"),
        ("11", f"concat('C', {d.text('user_id')})"),
        ("17", f"CASE WHEN event_type <> 'signup' THEN {d.text('event_id')} END"),
        ("150", status),
        ("39", status),
        ("55", f"concat('SYM', {d.text('user_id % 5')})"),
        ("54", d.text("user_id % 2 + 1")),
        ("60", f"concat({d.stamp('ts')}, '.', lpad({d.text('event_id % 1000')}, 3, '0'))"),
        ("14", f"CASE WHEN event_type IN ('view', 'purchase') THEN {d.text('event_id % 100')} END"),
        ("151", f"CASE WHEN event_type = 'view' THEN {d.text('event_id % 10 + 1')} END"),
    ]
    return d.sealed("SELECT * FROM events", "event_id, user_id, ts, event_type", d.body(fields))


def sessions_sql(d: Dialect) -> str:
    """Signups as logons that name a version, others as application messages that don't."""
    fields = [
        ("35", "CASE WHEN event_type = 'signup' THEN 'A' ELSE 'D' END"),
        ("49", f"CASE WHEN event_id % 2 = 0 THEN concat('U', {d.text('user_id')}) ELSE 'GATE' END"),
        ("56", f"CASE WHEN event_id % 2 = 0 THEN 'GATE' ELSE concat('U', {d.text('user_id')}) END"),
        ("34", d.text("event_id")),
        ("52", d.stamp("ts")),
        ("1137", f"CASE WHEN event_type = 'signup' THEN {d.text('user_id % 12')} END"),
    ]
    return d.sealed("SELECT * FROM events", "event_id, user_id, event_type", d.body(fields), begin="'FIXT.1.1'")


def allocations_sql(d: Dialect) -> str:
    """An allocation an order, with its lines as entries of a group; every fifth declares one entry too many."""
    if d.duck:
        entries = f"string_agg(concat('11=L', l_linenumber, {SOH}, '37=P', l_partkey, {SOH}, '38=', CAST(l_quantity AS BIGINT), {SOH}), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)"
    else:
        entries = f"array_join(transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey, l_quantity))), x -> concat('11=L', x.l_linenumber, {SOH}, '37=P', x.l_partkey, {SOH}, '38=', CAST(x.l_quantity AS BIGINT), {SOH})), '')"
    source = f"SELECT l_orderkey, count(*) AS n, {entries} AS entries, min(l_shipdate) AS day FROM lineitem GROUP BY l_orderkey"
    front = [("35", "'J'"), ("49", "'BUY1'"), ("56", "'SELL1'"), ("34", d.text("l_orderkey")), ("52", d.stamp("day")), ("70", f"concat('A', {d.text('l_orderkey')})"), ("71", "'0'"), ("626", "'1'"), ("857", "'1'"), ("73", d.text("n + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END"))]
    back = [("54", "'1'"), ("55", "'SYM'"), ("53", "'100'"), ("6", "'10.5'"), ("75", f"replace({d.day('day')}, '-', '')")]
    return d.sealed(source, "l_orderkey, n", f"concat({d.body(front)}, entries, {d.body(back)})")


def parties_sql(d: Dialect) -> str:
    """An order a supplier, with two parties, the first with two sub-identifiers; every sixth lacks one's delimiter."""
    part = [("453", "'2'"), ("448", f"concat('S', {d.text('s_suppkey')})"), ("447", "'D'"), ("452", "'1'"), ("802", "'2'"), ("523", "'desk'"), ("803", "'1'"), ("523", "CASE WHEN s_suppkey % 6 <> 0 THEN 'floor' END"), ("803", "'2'"), ("448", f"concat('N', {d.text('s_nationkey')})"), ("447", "'D'"), ("452", "'3'")]
    front = [("35", "'D'"), ("49", "'BUY1'"), ("56", "'SELL1'"), ("34", d.text("s_suppkey")), ("52", "'20240102-10:00:00'"), ("11", f"concat('CL', {d.text('s_suppkey')})")]
    back = [("21", "'1'"), ("55", "'SYM'"), ("54", "'1'"), ("60", "'20240102-10:00:00'"), ("38", "'100'"), ("40", "'1'")]
    return d.sealed("SELECT * FROM supplier", "s_suppkey, s_nationkey", d.body([*front, *part, *back]))


def views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def table(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    views(spark, sf_dir, *tables)
    return spark.sql(sql)


def orders_log(spark: SparkSession, sf_dir: str, corrupt: bool = False) -> DataFrame:
    """Log lines (source, line_no, line): text, a message, more text."""
    df = table(spark, sf_dir, orders_sql(SPARK, corrupt), "orders")
    return df.selectExpr("'orders' AS source", "o_orderkey AS line_no", f"concat({SPARK.day('o_orderdate')}, ' INFO ', msg, ' tail') AS line")


def lines_of(df: DataFrame, source: str, line_no: str) -> DataFrame:
    return df.selectExpr(f"'{source}' AS source", f"CAST({line_no} AS BIGINT) AS line_no", "msg AS line")


def messages_of(df: DataFrame, source: str, line_no: str) -> DataFrame:
    """Messages (seq, source, line_no, msg_idx, raw, fields) whose sequence is a column of their own."""
    from tagstream.operators.extract import extract_messages, with_fields

    found = extract_messages(lines_of(df, source, line_no))
    return with_fields(found.withColumn("seq", found["line_no"]))
