"""All queries over the driver's tables, and their DuckDB equivalents.

The tables hold no messages, so messages are made from their rows. Oracles compute the expected answer from the
base table wherever that is possible, so that a fault of the parser can't cancel out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagstream.functions import fields as fx
from tagstream.functions import sql as sql_functions
from tagstream.operators import enrich, extract, groups, lifecycle, reassembly, redact, render, validate
from tagstream.operators.shared import materialize, work_path
from tagstream.plans import builtin, synth
from tagstream.plans.synth import DUCK, SPARK
from tagstream.sources.dictionary import Registry, buckets, sensitive_tags
from tagstream.streaming import follow, state

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return add


# -- inputs


def orders_messages(spark: SparkSession, d: str, corrupt: bool = False) -> DataFrame:
    found = extract.extract_messages(synth.orders_log(spark, d, corrupt))
    return extract.with_fields(found.withColumn("seq", F.col("line_no")))


def resolved_orders(spark: SparkSession, d: str, registry: Registry, corrupt: bool = False) -> DataFrame:
    m = enrich.resolve(orders_messages(spark, d, corrupt), registry)
    return enrich.with_message_type(m, registry)


def corrupt_orders(spark: SparkSession, d: str) -> tuple[DataFrame, Registry]:
    registry = Registry()
    return resolved_orders(spark, d, registry, corrupt=True), registry


def event_messages(spark: SparkSession, d: str) -> DataFrame:
    df = synth.table(spark, d, synth.events_sql(SPARK), "events")
    return synth.messages_of(df, "events", "event_id")


def keyed_events(spark: SparkSession, d: str) -> DataFrame:
    registry = Registry()
    m = enrich.with_message_type(enrich.resolve(event_messages(spark, d), registry), registry)
    return lifecycle.single_id(lifecycle.events(m, registry))


def allocation_messages(spark: SparkSession, d: str) -> DataFrame:
    df = synth.table(spark, d, synth.allocations_sql(SPARK), "lineitem")
    return synth.messages_of(df, "alloc", "l_orderkey")


def party_messages(spark: SparkSession, d: str, registry: Registry) -> DataFrame:
    df = synth.table(spark, d, synth.parties_sql(SPARK), "supplier")
    return enrich.with_message_type(enrich.resolve(synth.messages_of(df, "parties", "s_suppkey"), registry), registry)


# -- extraction and fields

_ORDERS, _CORRUPT = synth.orders_sql(DUCK), synth.orders_sql(DUCK, True)


@query(f"SELECT o_orderkey AS line_no, 0 AS msg_idx, md5(msg) AS md5 FROM ({_ORDERS})")
def extract_messages(spark, d):
    return extract.extract_messages(synth.orders_log(spark, d)).select("line_no", "msg_idx", F.md5("raw").alias("md5"))


@query(f"SELECT o_custkey AS line_no, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS msg_idx, md5(msg) AS md5 FROM ({_ORDERS})")
def extract_multi_per_line(spark, d):
    made = synth.table(spark, d, synth.orders_sql(SPARK), "orders")
    lines = made.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "msg"))).alias("all"))
    lines = lines.select(F.lit("s").alias("source"), F.col("o_custkey").alias("line_no"), F.concat(F.lit("a 8=FI X "), F.array_join(F.col("all.msg"), " | ")).alias("line"))
    return extract.extract_messages(lines).select("line_no", "msg_idx", F.md5("raw").alias("md5"))


@query("SELECT o_orderkey AS line_no, concat('plain ', o_orderstatus, ' 10=123') AS line FROM orders WHERE o_orderkey % 4 = 0")
def lines_passed_through(spark, d):
    made = synth.table(spark, d, synth.orders_sql(SPARK), "orders").join(spark.table("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    lines = made.selectExpr("'s' AS source", "o_orderkey AS line_no", "CASE WHEN o_orderkey % 4 = 0 THEN concat('plain ', o_orderstatus, ' 10=123') ELSE msg END AS line")
    return extract.lines_without_messages(lines).select("line_no", "line")


@query("SELECT o_orderkey AS line_no, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders")
def global_sequence(spark, d):
    return extract.number_messages(extract.extract_messages(synth.orders_log(spark, d))).select("line_no", "seq")


_PLACES = {8: "'FIX.4.4'", 35: "'D'", 49: "'BUY1'", 56: "'SELL1'", 34: "CAST(o_orderkey AS VARCHAR)", 52: "strftime(o_orderdate, '%Y%m%d-%H:%M:%S')", 11: "concat('CL', o_orderkey)", 1: "concat('ACC', o_custkey)", 21: "'1'", 55: "concat('SYM', o_custkey % 7)", 54: "CAST(o_orderkey % 2 + 1 AS VARCHAR)", 60: "strftime(o_orderdate, '%Y%m%d-%H:%M:%S')", 38: "CAST((o_orderkey % 9 + 1) * 100 AS VARCHAR)", 40: "'2'", 44: "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)", 59: "CASE WHEN o_orderpriority LIKE '1%' THEN '3' WHEN o_orderpriority LIKE '2%' THEN '1' ELSE '0' END"}


@query(" UNION ALL ".join(f"SELECT o_orderkey AS seq, {i if i == 1 else i + 1} AS pos, CAST({tag} AS BIGINT) AS tag, {value} AS value FROM orders" for i, (tag, value) in enumerate(_PLACES.items(), 1)))
def tokenise_fields(spark, d):
    return extract.explode_fields(orders_messages(spark, d), "seq").where("tag not in (9, 10)")


@query(f"SELECT o_orderkey AS seq, {_PLACES[59]} AS first_59, CASE WHEN o_orderkey % 23 = 0 THEN '0' ELSE {_PLACES[59]} END AS last_59, 'D' AS raw_35, CASE WHEN o_orderkey % 23 = 0 THEN '0' ELSE {_PLACES[59]} END AS map_59 FROM orders")
def tag_first_and_last(spark, d):
    m = orders_messages(spark, d, corrupt=True)
    f = F.col("fields")
    return m.select("seq", fx.first_value(f, 59).alias("first_59"), fx.last_value(f, 59).alias("last_59"), fx.raw_value(F.col("raw"), 35).alias("raw_35"), fx.tag_map(f)[F.lit(59).cast("bigint")].alias("map_59"))


@query("SELECT o_orderkey AS seq, o_orderkey % 7 <> 0 AS ok FROM orders")
def checksum_valid(spark, d):
    m = orders_messages(spark, d, corrupt=True)
    return m.select("seq", fx.checksum_error(F.col("raw"), F.col("fields")).isNull().alias("ok"))


@query("SELECT o_orderkey AS seq, o_orderkey % 19 <> 0 AS ok FROM orders")
def body_length_valid(spark, d):
    m = orders_messages(spark, d, corrupt=True)
    return m.select("seq", fx.body_length_error(F.col("raw"), F.col("fields")).isNull().alias("ok"))


@query(f"SELECT o_orderkey AS seq, replace(msg, chr(1), '|') AS text FROM ({_ORDERS})")
def delimiter_translation(spark, d):
    return orders_messages(spark, d).select("seq", fx.shown(F.col("raw"), "|").alias("text"))


@query(f"SELECT o_orderkey AS seq, 'D' AS msg_type, substr(msg, length(msg) - 3, 3) AS checksum, length(msg) - strpos(msg, concat(chr(1), '35=')) - 7 AS body_length, o_orderkey % 2 = 0 AS even FROM ({_ORDERS})")
def sql_function_calls(spark, d):
    sql_functions.register(spark)
    orders_messages(spark, d).createOrReplaceTempView("made_messages")
    return spark.sql("SELECT seq, fix_tag(raw, 35) AS msg_type, fix_checksum(raw) AS checksum, CAST(fix_body_length(raw) AS BIGINT) AS body_length, filter(fix_fields(raw), f -> f.tag = 54)[0].value = '1' AS even FROM made_messages")


# -- dictionaries

_ENUMS = "(VALUES ('54', 'Side', '1', 'BUY'), ('54', 'Side', '2', 'SELL'), ('40', 'OrdType', '2', 'LIMIT'), ('59', 'TimeInForce', '3', 'IMMEDIATE_OR_CANCEL'), ('59', 'TimeInForce', '1', 'GOOD_TILL_CANCEL'), ('59', 'TimeInForce', '0', 'DAY')) AS e(tag, name, code, description)"


@query(f"SELECT CAST(e.tag AS BIGINT) AS tag, e.name, e.code AS value, e.description, count(*) AS n FROM (SELECT '54' AS tag, {_PLACES[54]} AS v FROM orders UNION ALL SELECT '40', '2' FROM orders UNION ALL SELECT '59', {_PLACES[59]} FROM orders) f JOIN {_ENUMS} ON e.tag = f.tag AND e.code = f.v GROUP BY 1, 2, 3, 4")
def enrich_names_enums(spark, d):
    registry = Registry()
    m = enrich.resolve(orders_messages(spark, d), registry)
    rows = m.select("seq", "dict_key", "fallback_key", F.explode("fields").alias("f")).select("seq", "dict_key", "fallback_key", "f.*").where("tag in (54, 40, 59)")
    return enrich.enrich_fields(rows, registry).groupBy("tag", "name", "value", "description").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS seq, printf('%4d (%s): %s%s', 54, 'Side', CAST(o_orderkey % 2 + 1 AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN ' (BUY)' ELSE ' (SELL)' END) AS text FROM orders UNION ALL SELECT o_orderkey, printf('%4d (%s): %s', 11, 'ClOrdID', concat('CL', o_orderkey)) FROM orders")
def render_fields(spark, d):
    registry = Registry()
    m = enrich.resolve(orders_messages(spark, d), registry)
    rows = m.select("seq", "dict_key", "fallback_key", F.explode("fields").alias("f")).select("seq", "dict_key", "fallback_key", "f.*").where("tag in (54, 11)")
    return enrich.render_fields(enrich.enrich_fields(rows, registry)).select("seq", "text")


@query(f"SELECT o_orderkey AS seq, CAST(18 AS BIGINT) AS n_lines, printf('%4d (%s): %s', 44, 'Price', {_PLACES[44]}) AS price_line FROM orders")
def render_messages(spark, d):
    registry = Registry()
    text = enrich.render_messages(enrich.resolve(orders_messages(spark, d), registry), registry)
    lines = F.split("text", "\n")
    return text.select("seq", F.size(lines).cast("bigint").alias("n_lines"), F.get(F.filter(lines, lambda x: x.startswith("  44 ")), F.lit(0)).alias("price_line"))


_KIND = "CASE WHEN event_type = 'signup' THEN 'D' ELSE '8' END"


@query(f"SELECT {_KIND} AS msg_type, CASE WHEN event_type = 'signup' THEN 'NewOrderSingle' ELSE 'ExecutionReport' END AS name, 'Order Flow' AS bucket, CAST(1 AS INTEGER) AS bucket_order, count(*) AS n FROM events GROUP BY 1, 2")
def msgtype_counts(spark, d):
    registry = Registry()
    m = enrich.with_message_type(enrich.resolve(event_messages(spark, d), registry), registry)
    return enrich.count_report(enrich.count_messages(enrich.with_bucket(m)))


@query("SELECT CASE WHEN event_type = 'signup' THEN 'Session/Admin' ELSE 'Order Flow' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def bucket_counts(spark, d):
    registry = Registry()
    m = synth.messages_of(synth.table(spark, d, synth.sessions_sql(SPARK), "events"), "s", "event_id")
    m = enrich.with_bucket(enrich.with_message_type(enrich.resolve(m, registry), registry))
    return m.groupBy("bucket").agg(F.count("*").alias("n"))


_BEGIN = "CASE o_orderkey % 6 WHEN 0 THEN 'FIX.4.0' WHEN 1 THEN 'FIX.4.2' WHEN 2 THEN 'FIX.2.7' WHEN 3 THEN 'FIXT.1.1' WHEN 4 THEN 'FIX.9.9' ELSE 'FIX.4.4' END"


@query("SELECT o_orderkey AS seq, CASE o_orderkey % 6 WHEN 0 THEN 'FIX40' WHEN 1 THEN 'FIX42' WHEN 2 THEN 'FIX40' WHEN 3 THEN CASE o_orderkey % 4 WHEN 0 THEN 'FIX50SP2' WHEN 1 THEN 'FIX44' WHEN 2 THEN 'FIX50' ELSE 'FIX50SP1' END WHEN 4 THEN 'FIX44' ELSE 'FIX44' END AS dict_key, CASE WHEN o_orderkey % 6 = 3 AND o_orderkey % 4 <> 1 THEN 'FIXT11' END AS fallback_key FROM orders")
def version_detect(spark, d):
    body = SPARK.body([("35", "'D'"), ("1128", "CASE o_orderkey % 4 WHEN 0 THEN '9' WHEN 1 THEN '6' END"), ("1137", "CASE o_orderkey % 4 WHEN 0 THEN '7' WHEN 2 THEN '77' WHEN 3 THEN '8' END")])
    df = synth.table(spark, d, SPARK.sealed("SELECT * FROM orders", "o_orderkey", body, begin=_BEGIN), "orders")
    return enrich.resolve(synth.messages_of(df, "v", "o_orderkey"), Registry()).select("seq", "dict_key", "fallback_key")


_VERSION = "CASE WHEN user_id % 12 > 9 THEN NULL ELSE CASE user_id % 12 " + " ".join(f"WHEN {k} THEN '{builtin.ALIASES.get(v, v)}'" for k, v in builtin.APPL_VERSIONS.items()) + " END END"


@query(
    f"""WITH v AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'signup' THEN {_VERSION} END AS named FROM events),
    w AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v)
    SELECT event_id AS seq, coalesce(named, before, 'FIX50') AS dict_key FROM w"""
)
def session_default_asof(spark, d):
    df = synth.table(spark, d, synth.sessions_sql(SPARK), "events")
    return enrich.resolve(synth.messages_of(df, "s", "event_id"), Registry()).select("seq", "dict_key")


@query("SELECT event_id AS seq, 'FIX42' AS dict_key, 'FIX44' AS fallback_key, 'DetectedOverride' AS fallback_role FROM events")
def override_fallback(spark, d):
    return enrich.resolve(event_messages(spark, d), Registry(), override="4.2").select("seq", "dict_key", "fallback_key", "fallback_role")


def _values(rows: list[tuple], columns: str) -> str:
    text = lambda v: "NULL" if v is None else ("true" if v is True else "false" if v is False else f"'{v}'" if isinstance(v, str) else str(v))
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


@query(_values([("0", "Heartbeat", "admin"), ("1", "TestRequest", "admin"), ("2", "ResendRequest", "admin"), ("3", "Reject", "admin"), ("4", "SequenceReset", "admin"), ("5", "Logout", "admin"), ("8", "ExecutionReport", "app"), ("9", "OrderCancelReject", "app"), ("A", "Logon", "admin"), ("BN", "ExecutionAcknowledgement", "app"), ("D", "NewOrderSingle", "app"), ("F", "OrderCancelRequest", "app"), ("G", "OrderCancelReplaceRequest", "app"), ("H", "OrderStatusRequest", "app"), ("J", "AllocationInstruction", "app"), ("W", "MarketDataSnapshotFullRefresh", "app")], "msg_type, name, category"))
def dictionary_messages(spark, d):
    return Registry().table(spark, "message", ["FIX44"]).select("msg_type", "name", "category")


@query("SELECT * FROM (VALUES ('FIX44', 16, 7), ('FIX42', 16, 7), ('FIXT11', 7, 0)) AS t(dict_key, n_messages, n_components)")
def dictionary_info(spark, d):
    registry = Registry()
    messages = registry.table(spark, "message", ["FIX44", "FIX42", "FIXT11"]).groupBy("dict_key").agg(F.countDistinct("name").cast("int").alias("n_messages"))
    trees = registry.table(spark, "tree", ["FIX44", "FIX42", "FIXT11"]).where("kind = 'component' or root in ('Header', 'Trailer')").groupBy("dict_key").agg(F.countDistinct(F.when(F.col("kind") == "component", F.col("name"))).cast("int").alias("n_components"))
    return messages.join(trees, "dict_key", "left").select("dict_key", "n_messages", F.coalesce("n_components", F.lit(0)).alias("n_components"))


@query(_values([("0", 1, "group", "NoPartyIDs", 453, False), ("0.0", 2, "field", "PartyID", 448, False), ("0.1", 2, "field", "PartyIDSource", 447, False), ("0.2", 2, "field", "PartyRole", 452, False), ("0.3", 2, "component", "PtysSubGrp", None, False), ("0.3.0", 3, "group", "NoPartySubIDs", 802, False), ("0.3.0.0", 4, "field", "PartySubID", 523, False), ("0.3.0.1", 4, "field", "PartySubIDType", 803, False)], "path, depth, kind, name, tag, required"))
def component_tree(spark, d):
    tree = Registry().table(spark, "tree", ["FIX44"]).where("root = 'Parties'")
    return tree.select(F.array_join("path", ".").alias("path"), "depth", "kind", "name", F.col("tag").cast("int").alias("tag"), "required")


@query(_values([(i, tag, req) for i, (tag, req) in enumerate([(8, True), (9, True), (35, True), (49, True), (56, True), (115, False), (128, False), (34, True), (50, False), (142, False), (57, False), (143, False), (43, False), (52, True), (37, False), (11, True), (790, False), (1, False), (55, True), (48, False), (54, True), (93, False), (89, False), (10, True)])], "ord, tag, required"))
def message_expansion(spark, d):
    return Registry().table(spark, "order", ["FIX44"]).where("msg_type = 'H'").select("ord", F.col("tag").cast("int").alias("tag"), "required")


@query(_values([("453", None, 448, 447), ("453", None, 448, 448), ("453", None, 448, 452), ("453", None, 448, 802), ("78", None, 79, 79), ("78", None, 79, 80), ("802", "453", 523, 523), ("802", "453", 523, 803)], "count_tag, parent_tag, delimiter, tag"))
def group_specifications(spark, d):
    g = Registry().table(spark, "group", ["FIX44"]).where("msg_type = 'D'")
    return g.select(F.col("count_tag").cast("string").alias("count_tag"), F.col("parent_tag").cast("string").alias("parent_tag"), F.col("delimiter").cast("int").alias("delimiter"), F.col("tag").cast("int").alias("tag"))


@query(_values([(1, "Account"), (49, "SenderCompID"), (50, "SenderSubID"), (56, "TargetCompID"), (57, "TargetSubID"), (79, "AllocAccount"), (115, "OnBehalfOfCompID"), (128, "DeliverToCompID"), (142, "SenderLocationID"), (143, "TargetLocationID"), (523, "PartySubID"), (553, "Username"), (554, "Password"), (802, "NoPartySubIDs"), (803, "PartySubIDType")], "tag, name"))
def sensitive_tag_names(spark, d):
    return sensitive_tags(spark, Registry()).select(F.col("tag").cast("int").alias("tag"), "name")


@query("SELECT bucket, n FROM (VALUES ('Session/Admin', 8), ('Order Flow', 32), ('Quotes & Pricing', 11), ('Market Data', 10), ('Post-Trade & Allocation', 27), ('Positions, Collateral & Risk', 30), ('Reference Data & Definitions', 33), ('Other Business', 13)) AS t(bucket, n)")
def bucket_listing(spark, d):
    return buckets(spark).groupBy("bucket").agg(F.count("*").cast("int").alias("n"))


# -- validation


def _rule(rule: str) -> Query:
    def f(spark, d):
        m, registry = corrupt_orders(spark, d)
        return validate.violations(m, registry).where(F.col("rule") == rule).select("seq", F.col("tag").cast("int").alias("tag"))

    f.__name__ = f"violation_{rule}"
    return f


for _name, _when, _tag in [("checksum", 7, 10), ("required", 11, 54), ("out_of_order", 13, 38), ("enum", 17, 40), ("body_length", 19, 9), ("duplicate_tag", 23, 59), ("type", 29, 38), ("unknown_tag", 31, 9999)]:
    query(f"SELECT o_orderkey AS seq, {_tag} AS tag FROM orders WHERE o_orderkey % {_when} = 0")(_rule(_name))


@query(
    f"""SELECT o_orderkey AS seq, concat_ws('; ',
      CASE WHEN o_orderkey % 23 = 0 THEN 'duplicate tag 59' END,
      CASE WHEN o_orderkey % 19 = 0 THEN concat('body length mismatch: declared ', regexp_extract(msg, '9=([0-9]+)', 1), ', computed ', CAST(regexp_extract(msg, '9=([0-9]+)', 1) AS INTEGER) - 1) END,
      CASE WHEN o_orderkey % 31 = 0 THEN 'unknown tag 9999 in FIX44' END,
      CASE WHEN o_orderkey % 17 = 0 THEN 'tag 40: value Z is not listed' END,
      CASE WHEN o_orderkey % 29 = 0 THEN 'tag 38: abc is no QTY' END,
      CASE WHEN o_orderkey % 11 = 0 THEN 'required tag 54 missing' END,
      CASE WHEN o_orderkey % 13 = 0 THEN 'tag 38 out of order' END,
      CASE WHEN o_orderkey % 7 = 0 THEN concat('checksum mismatch: declared ', substr(msg, length(msg) - 3, 3), ', computed ', lpad(CAST((CAST(substr(msg, length(msg) - 3, 3) AS INTEGER) + 255) % 256 AS VARCHAR), 3, '0')) END) AS reason
    FROM ({_CORRUPT}) WHERE {' OR '.join(f'o_orderkey % {n} = 0' for n in (7, 11, 13, 17, 19, 23, 29, 31))}"""
)
def violation_reason(spark, d):
    m, registry = corrupt_orders(spark, d)
    return validate.reasons(validate.violations(m, registry))


@query(f"SELECT count(*) AS n_invalid FROM orders WHERE {' OR '.join(f'o_orderkey % {n} = 0' for n in (7, 11, 13, 17, 19, 23, 29, 31))}")
def invalid_messages(spark, d):
    m, registry = corrupt_orders(spark, d)
    return validate.invalid(m, validate.violations(m, registry)).agg(F.count("*").alias("n_invalid"))


@query("SELECT o_orderkey AS seq FROM orders WHERE 1 = 0")
def clean_messages_have_no_violations(spark, d):
    registry = Registry()
    return validate.violations(resolved_orders(spark, d, registry), registry).select("seq")


# -- groups


@query("SELECT l_orderkey AS seq, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INTEGER) AS entry, concat('L', l_linenumber) AS line, concat('P', l_partkey) AS part, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty FROM lineitem")
def group_explode(spark, d):
    m = groups.explode_flat_group(allocation_messages(spark, d), 73, 11, [11, 37, 38], "seq")
    f = F.col("entry_fields")
    return m.select("seq", "entry", fx.first_value(f, 11).alias("line"), fx.first_value(f, 37).alias("part"), fx.first_value(f, 38).alias("qty"))


@query("SELECT l_orderkey AS seq, CAST(73 AS BIGINT) AS tag, concat('group 73: declared ', count(*) + 1, ', found ', count(*)) AS text FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_orderkey")
def group_count_mismatch(spark, d):
    registry = Registry()
    m = enrich.with_message_type(enrich.resolve(allocation_messages(spark, d), registry), registry)
    return validate.walked_rules(m, registry).where("rule = 'group_count_mismatch'").select("seq", "tag", "text")


def _nested(rows: list[tuple[str, int, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT s_suppkey AS seq, '{path}' AS path, CAST({tag} AS BIGINT) AS tag, {value} AS value FROM supplier WHERE {when}" for path, tag, value, when in rows)


@query(
    _nested(
        [
            ("453[1]", 448, "concat('S', s_suppkey)", "true"),
            ("453[1]", 447, "'D'", "true"),
            ("453[1]", 452, "'1'", "true"),
            ("453[1]", 802, "'2'", "true"),
            ("453[1]/802[1]", 523, "'desk'", "true"),
            ("453[1]/802[1]", 803, "'1'", "true"),
            ("453[1]/802[2]", 523, "'floor'", "s_suppkey % 6 <> 0"),
            ("453[1]/802[2]", 803, "'2'", "s_suppkey % 6 <> 0"),
            ("453[1]/802[1]", 803, "'2'", "s_suppkey % 6 = 0"),
            ("453[2]", 448, "concat('N', s_nationkey)", "true"),
            ("453[2]", 447, "'D'", "true"),
            ("453[2]", 452, "'3'", "true"),
        ]
    )
)
def group_nested(spark, d):
    registry = Registry()
    steps = groups.walk_groups(party_messages(spark, d, registry), registry, groups.VALIDATE, only_groups=True)
    return steps.where("rule is null").select("seq", "path", "tag", "value")


@query("SELECT s_suppkey AS seq, 'group_count_mismatch' AS rule, CAST(802 AS BIGINT) AS tag FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT s_suppkey, 'duplicate_tag', 803 FROM supplier WHERE s_suppkey % 6 = 0")
def group_faults(spark, d):
    registry = Registry()
    return validate.violations(party_messages(spark, d, registry), registry).select("seq", "rule", "tag")


#: A private dictionary in XML form: one message with a group that requires its second member.
CUSTOM_XML = """<fix type="FIX" major="4" minor="9"><header><field name="BeginString" required="Y"/><field name="BodyLength" required="Y"/><field name="MsgType" required="Y"/></header>
<messages><message name="Zed" msgtype="Z" msgcat="app"><group name="NoLegs" required="N"><field name="Leg" required="N"/><field name="Size" required="Y"/></group></message></messages>
<components/><trailer><field name="CheckSum" required="Y"/></trailer>
<fields><field number="8" name="BeginString" type="STRING"/><field number="9" name="BodyLength" type="LENGTH"/><field number="35" name="MsgType" type="STRING"/><field number="10" name="CheckSum" type="STRING"/><field number="200" name="NoLegs" type="NUMINGROUP"/><field number="201" name="Leg" type="STRING"/><field number="202" name="Size" type="QTY"/></fields></fix>"""


@query("SELECT s_suppkey AS seq, CASE s_suppkey % 4 WHEN 0 THEN 'group_required' WHEN 1 THEN 'group_before_delimiter' WHEN 2 THEN 'group_out_of_order' END AS rule FROM supplier WHERE s_suppkey % 4 <> 3 UNION ALL SELECT s_suppkey, 'group_member_outside' FROM supplier WHERE s_suppkey % 4 = 3")
def custom_dictionary_groups(spark, d):
    registry = Registry()
    registry.add_xml(CUSTOM_XML.replace('<field name="Leg" required="N"/><field name="Size" required="Y"/>', '<field name="Leg" required="N"/><field name="Size" required="Y"/><field name="Note" required="N"/>').replace("</fields>", '<field number="203" name="Note" type="STRING"/></fields>'))
    entry = "CASE s_suppkey % 4 WHEN 0 THEN concat('201=a', chr(1)) WHEN 1 THEN concat('202=5', chr(1), '201=a', chr(1), '202=5', chr(1)) WHEN 2 THEN concat('201=a', chr(1), '203=n', chr(1), '202=5', chr(1)) ELSE concat('201=a', chr(1), '202=5', chr(1), '201=b', chr(1), '202=6', chr(1)) END"
    df = synth.table(spark, d, SPARK.sealed("SELECT * FROM supplier", "s_suppkey", f"concat('35=Z', chr(1), '200=1', chr(1), {entry})", begin="'FIX.4.9'"), "supplier")
    m = enrich.with_message_type(enrich.resolve(synth.messages_of(df, "z", "s_suppkey"), registry), registry)
    found = validate.violations(m, registry).where("rule like 'group%'")
    return found.select("seq", "rule").distinct()


# -- redaction

_ACCOUNTS = "SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey)) AS n FROM orders GROUP BY o_custkey"
_HIDDEN = [(t, {"49": "'SenderCompID0001'", "56": "'TargetCompID0001'", "1": "printf('Account%04d', n)"}.get(t, v)) for t, v in synth.order_fields(DUCK)]
_REDACTED = DUCK.sealed(f"SELECT orders.*, a.n FROM orders JOIN ({_ACCOUNTS}) a USING (o_custkey)", "o_orderkey, o_orderdate", DUCK.body(_HIDDEN))


@query(f"SELECT CAST(1 AS BIGINT) AS tag, concat('ACC', o_custkey) AS value, printf('Account%04d', n) AS alias FROM ({_ACCOUNTS}) UNION ALL SELECT 49, 'BUY1', 'SenderCompID0001' UNION ALL SELECT 56, 'SELL1', 'TargetCompID0001'")
def redact_aliases(spark, d):
    return redact.aliases(orders_messages(spark, d), Registry()).select("tag", "value", "alias")


@query(f"SELECT o_orderkey AS line_no, md5(msg) AS md5 FROM ({_REDACTED})")
def redact_rebuild(spark, d):
    return redact.redact_messages(orders_messages(spark, d), Registry()).select("line_no", F.md5("redacted").alias("md5"))


@query(f"SELECT o_orderkey AS line_no, md5(concat(strftime(o_orderdate, '%Y-%m-%d'), ' INFO ', msg, ' tail')) AS md5 FROM ({_REDACTED})")
def redact_lines(spark, d):
    done = redact.redact_messages(orders_messages(spark, d), Registry())
    return redact.redact_lines(synth.orders_log(spark, d), done).select("line_no", F.md5("clean").alias("md5"))


# -- order lifecycle

_STATE = "CASE event_type WHEN 'click' THEN 'New' WHEN 'view' THEN 'Partially Filled' WHEN 'purchase' THEN 'Filled' WHEN 'error' THEN 'Rejected' ELSE 'Unknown' END"
_TIME = "concat(strftime(ts, '%Y%m%d-%H:%M:%S'), '.', lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0'))"
_EVENTS = f"SELECT event_id, user_id, event_type, {_STATE} AS state, {_TIME} AS t FROM events"
_CHANGES = f"SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before, lead(state) OVER (PARTITION BY user_id ORDER BY t, event_id) AS after FROM ({_EVENTS}) e) x WHERE before IS NULL OR before <> state"
_PATHS = f"SELECT user_id, string_agg(state, ' -> ' ORDER BY t, event_id) AS whole, last(state ORDER BY t, event_id) AS last_state, count(*) AS n_states FROM ({_CHANGES}) c GROUP BY user_id"
_FLOWS = f"SELECT user_id, CASE WHEN n_states > 1 AND whole LIKE 'Unknown -> %' THEN substr(whole, 12) ELSE whole END AS flow, last_state, n_states FROM ({_PATHS}) p"
_TERMINAL = "last_state IN ('Filled', 'Rejected')"


@query(f"SELECT event_id AS seq, concat('ORD', user_id) AS order_key, {_KIND} AS msg_type, state, t AS event_time FROM ({_EVENTS})")
def order_events(spark, d):
    return keyed_events(spark, d).select("seq", "order_key", "msg_type", "state", "event_time")


@query(f"SELECT concat('ORD', user_id) AS order_key, flow, last_state, CAST(n_states AS INTEGER) AS n_states FROM ({_FLOWS})")
def order_state_path(spark, d):
    return lifecycle.state_paths(keyed_events(spark, d)).select("order_key", "flow", "last_state", F.size("states").alias("n_states"))


@query(
    """SELECT concat('ORD', user_id) AS order_key, concat('C', user_id) AS cl_ord_id, concat('SYM', user_id % 5) AS symbol,
    max(CAST(event_id % 100 AS VARCHAR)) FILTER (event_id = lc) AS cum_qty, max(CAST(event_id % 10 + 1 AS VARCHAR)) FILTER (event_id = ll) AS leaves_qty,
    count(*) AS n_messages, min(event_id) AS first_seq, max(event_id) AS last_seq
    FROM (SELECT *, max(event_id) FILTER (event_type IN ('view', 'purchase')) OVER (PARTITION BY user_id) AS lc, max(event_id) FILTER (event_type = 'view') OVER (PARTITION BY user_id) AS ll FROM events) GROUP BY user_id"""
)
def order_latest(spark, d):
    return lifecycle.order_attributes(keyed_events(spark, d)).select("order_key", "cl_ord_id", "symbol", "cum_qty", "leaves_qty", "n_messages", "first_seq", "last_seq")


@query(f"SELECT concat('ORD', user_id) AS order_key, concat('ORD', user_id) AS display_id, {_TERMINAL} AS is_terminal FROM ({_FLOWS})")
def order_terminal(spark, d):
    return lifecycle.order_records(keyed_events(spark, d)).select("order_key", "display_id", "is_terminal")


@query(f"SELECT count(*) AS n_total, count(*) FILTER (NOT ({_TERMINAL})) AS n_open, count(*) FILTER ({_TERMINAL}) AS n_terminal FROM ({_FLOWS})")
def order_totals(spark, d):
    return lifecycle.order_totals(lifecycle.order_records(keyed_events(spark, d)))


@query(
    f"""SELECT concat('ORD', user_id) AS display_id, flow, CASE user_id % 2 WHEN 0 THEN 'BUY' ELSE 'SELL' END AS side, concat('SYM', user_id % 5) AS symbol, trade_date, 'ValueDate' AS settle_name, {_TERMINAL} AS is_terminal
    FROM ({_FLOWS}) JOIN (SELECT user_id, strftime(arg_max(ts, event_id), '%Y%m%d') AS trade_date FROM events GROUP BY user_id) USING (user_id)"""
)
def order_summary(spark, d):
    rows = lifecycle.summary_rows(lifecycle.report_order(lifecycle.order_records(keyed_events(spark, d))))
    return rows.select("display_id", "flow", "side", "symbol", "trade_date", "settle_name", "is_terminal")


@query("SELECT count(*) AS n_events, CAST(count(DISTINCT user_id) AS BIGINT) AS n_orders FROM events")
def event_dedupe(spark, d):
    keyed = keyed_events(spark, d)
    twice = keyed.unionByName(keyed.withColumn("seq", F.col("seq") + 100_000_000))
    kept = lifecycle.ordered_events(twice)
    return kept.agg(F.count("*").alias("n_events"), F.countDistinct("order_key").alias("n_orders"))


_PLACE = "CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS INTEGER) AS place"


@query(
    f"""SELECT concat('ORD', user_id) AS order_key, {_PLACE}, t AS event_time, concat(CASE event_type WHEN 'signup' THEN 'NEW_ORDER_SINGLE' ELSE 'EXECUTION_REPORT' END, ' [C', user_id, ']') AS cell,
    coalesce(nullif(state, 'Unknown'), '-') AS exec_type, coalesce(nullif(state, 'Unknown'), '-') AS ord_status, '-' AS exec_ack,
    concat(CASE WHEN event_type IN ('view', 'purchase') THEN CAST(event_id % 100 AS VARCHAR) ELSE '-' END, '/', CASE WHEN event_type = 'view' THEN CAST(event_id % 10 + 1 AS VARCHAR) ELSE '-' END) AS cum_leaves,
    '-@-' AS last, '-' AS avg_px, state, '' AS text FROM ({_EVENTS})"""
)
def order_timeline(spark, d):
    return lifecycle.timeline(keyed_events(spark, d))


@query(f"SELECT concat('ORD', user_id) AS order_key, place, event_id AS seq, md5(replace(msg, chr(1), '|')) AS md5 FROM (SELECT user_id, event_id, {_PLACE} FROM ({_EVENTS})) JOIN (SELECT event_id, msg FROM ({synth.events_sql(DUCK)})) USING (event_id) JOIN (SELECT user_id FROM ({_FLOWS}) WHERE {_TERMINAL}) USING (user_id)")
def order_raw_messages(spark, d):
    keyed = keyed_events(spark, d)
    found = lifecycle.raw_messages(keyed, lifecycle.order_records(keyed), event_messages(spark, d), "|")
    return found.select("order_key", "place", "seq", F.md5("text").alias("md5"))


@query("SELECT o_orderkey AS seq, concat('C', o_custkey, '-1') AS order_key FROM orders")
def order_identity_chain(spark, d):
    numbered = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders"
    body = SPARK.body([("35", "CASE WHEN k = 1 THEN 'D' ELSE 'G' END"), ("34", "CAST(o_orderkey AS STRING)"), ("11", "concat('C', o_custkey, '-', k)"), ("41", "CASE WHEN k > 1 THEN concat('C', o_custkey, '-', k - 1) END")])
    df = synth.table(spark, d, SPARK.sealed(numbered, "o_orderkey", body), "orders")
    registry = Registry()
    m = enrich.with_message_type(enrich.resolve(synth.messages_of(df, "c", "o_orderkey"), registry), registry)
    return lifecycle.resolve_identity(lifecycle.events(m)).select("seq", "order_key")


@query(f"SELECT concat('ORD', o.user_id) AS order_key, e.msg_type, count(*) AS n FROM (SELECT user_id, max(event_id) AS last_seq FROM events GROUP BY user_id) o JOIN (SELECT event_id, {_KIND} AS msg_type FROM events) e ON e.event_id <= o.last_seq GROUP BY 1, 2")
def section_running_counts(spark, d):
    keyed = keyed_events(spark, d)
    return lifecycle.section_counts(lifecycle.order_attributes(keyed), keyed)


_DAYS = "(SELECT count(*) FROM generate_series(1, o_orderkey % 6) g(i) WHERE isodow(CAST(o_orderdate AS DATE) + CAST(g.i AS INTEGER)) < 6)"


@query(f"SELECT o_orderkey AS seq, CAST(days AS INTEGER) AS days, CASE WHEN days = 0 THEN 'TOD' WHEN days = 1 THEN 'TOM' WHEN days = 2 THEN 'SPOT' ELSE 'FWD' END AS tenor FROM (SELECT o_orderkey, {_DAYS} AS days FROM orders)")
def tenor_business_days(spark, d):
    synth.views(spark, d, "orders")
    df = spark.sql("SELECT o_orderkey AS seq, date_format(o_orderdate, 'yyyyMMdd') AS trade, date_format(date_add(o_orderdate, CAST(o_orderkey % 6 AS INT)), 'yyyyMMdd') AS settle FROM orders")
    return df.withColumn("days", fx.business_days(F.col("trade"), F.col("settle"))).select("seq", "days", fx.tenor(F.col("days")).alias("tenor"))


# -- capture


def packets(spark: SparkSession, d: str) -> DataFrame:
    """Messages of `orders` as TCP: a flow a message, segments of 37 bytes, out of order, every third twice."""
    made = synth.table(spark, d, synth.orders_sql(SPARK), "orders")
    made.createOrReplaceTempView("made_orders")
    return spark.sql(
        """
        WITH cut AS (SELECT o_orderkey, msg, explode(sequence(0, CAST((length(msg) - 1) / 37 AS INT))) AS i FROM made_orders),
        twice AS (SELECT *, explode(CASE WHEN i % 3 = 0 THEN array(0, 1) ELSE array(0) END) AS again FROM cut),
        data AS (SELECT o_orderkey, 1 + (i * 7 + again * 3 + o_orderkey) % 11 + again * 20 AS place, i, again, encode(substr(msg, 37 * i + 1, 37 + again * 5), 'UTF-8') AS payload FROM twice)
        SELECT 'cap' AS source, row_number() OVER (PARTITION BY o_orderkey ORDER BY place, i, again) AS packet_index, 0L AS ts_us, concat('10.0.', o_orderkey) AS src, '10.9.9.9' AS dst, 40000 AS sport, 12083 AS dport,
          CAST((4294967200 + 37 * i) % 4294967296 AS BIGINT) AS tcp_seq, false AS syn, false AS fin, false AS rst, payload, CAST(NULL AS STRING) AS loss FROM data
        UNION ALL SELECT 'cap', 0, 0L, concat('10.0.', o_orderkey), '10.9.9.9', 40000, 12083, 4294967200, true, false, false, CAST('' AS BINARY), NULL FROM made_orders
        """
    )


@query(f"SELECT concat('10.0.', o_orderkey) AS src, md5(msg) AS md5 FROM ({_ORDERS})")
def tcp_reassembly(spark, d):
    return reassembly.reassemble(packets(spark, d)).where("raw is not null").select("src", F.md5("raw").alias("md5"))


@query("SELECT CAST(0 AS BIGINT) AS n_losses")
def tcp_losses(spark, d):
    p = packets(spark, d)
    return reassembly.losses(p, reassembly.reassemble(p))


@query("SELECT count(*) AS n_lines FROM orders")
def capture_to_lines(spark, d):
    lines = reassembly.capture_lines(reassembly.reassemble(packets(spark, d)))
    return extract.extract_messages(lines).agg(F.count("*").alias("n_lines"))


# -- streaming: the same answers from files that arrive


def _followed(spark: SparkSession, d: str, sql: str, source: str) -> str:
    path = work_path(spark, "follow")
    materialize(synth.table(spark, d, sql, source).selectExpr("msg AS value"), "made").repartition(3).write.text(path)
    return path


@query(f"SELECT {_KIND} AS msg_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, d):
    return follow.run_counts(spark, _followed(spark, d, synth.events_sql(SPARK), "events"))


@query("SELECT concat('ORD', user_id) AS order_key, count(*) AS n_messages, max(event_id) AS last_seq FROM events GROUP BY user_id")
def stream_orders(spark, d):
    return follow.run_orders(spark, _followed(spark, d, synth.events_sql(SPARK), "events")).select("order_key", "n_messages", "last_seq")


@query("SELECT concat('10.0.', o_orderkey) AS src, CAST(length(msg) AS BIGINT) AS n FROM (" + _ORDERS + ")")
def stream_flows(spark, d):
    path, out = work_path(spark, "segments"), work_path(spark, "flows")
    p = materialize(packets(spark, d), "packets")
    for low, high in ((0, 8), (8, 1 << 30)):  # two files, the later packets in the second
        p.where(f"packet_index >= {low} and packet_index < {high}").coalesce(2).write.mode("append").parquet(f"{path}/{low:02d}")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/*")
    follow.drain(state.flow_messages(stream), "append", lambda q: q.format("parquet").option("path", out))
    found = spark.read.schema(state.FLOWS).parquet(out)
    return found.where("raw is not null").select("src", F.length("raw").cast("bigint").alias("n"))


@query(
    f"""WITH v AS (SELECT event_id, user_id, CASE WHEN event_type = 'signup' AND user_id % 12 <= 9 THEN {_VERSION.replace("'FIX40'", "'FIX40'")} END AS named FROM events)
    SELECT event_id AS seq, last_value(named IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS session_default FROM v"""
)
def stream_session_defaults(spark, d):
    path, out = work_path(spark, "session-log"), work_path(spark, "defaults")
    m = synth.messages_of(synth.table(spark, d, synth.sessions_sql(SPARK), "events"), "s", "event_id").select("seq", "raw")
    m.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("seq bigint, raw string").parquet(path).withColumn("fields", fx.fields(F.col("raw")))
    follow.drain(state.session_defaults(stream), "append", lambda q: q.format("parquet").option("path", out))
    found = spark.read.schema("seq bigint, raw string, session_default string").parquet(out)
    key = enrich.existing_key(F.col("session_default"), Registry())
    return found.select("seq", F.when(F.col("session_default").isNotNull(), key).alias("session_default"))


@query(f"SELECT concat('ACC', o_custkey) AS value, printf('Account%04d', n) AS alias FROM ({_ACCOUNTS})")
def stream_aliases(spark, d):
    path, out = work_path(spark, "fields"), work_path(spark, "aliases")
    m = orders_messages(spark, d).select("source", "seq", F.explode("fields").alias("f")).select("source", "seq", "f.tag", "f.value")
    m.join(enrich.small(sensitive_tags(spark, Registry()), 1000), "tag").repartition(1).write.parquet(path)
    stream = spark.readStream.schema("tag bigint, source string, seq bigint, value string, name string").parquet(path)
    follow.drain(state.aliases(stream), "append", lambda q: q.format("parquet").option("path", out))
    return spark.read.schema("source string, tag bigint, value string, alias string").parquet(out).where("tag = 1").select("value", "alias")


# -- rendering and browsing


@query("SELECT s_suppkey AS seq, CAST(CASE WHEN s_suppkey % 6 = 0 THEN 3 ELSE 4 END AS BIGINT) AS n_entries, '  PartyIDs 1' AS first_heading, printf('    %4d (%s): %s', 448, 'PartyID', concat('S', s_suppkey)) AS first_party FROM supplier")
def render_groups(spark, d):
    registry = Registry()
    lines = render.rendered_lines(party_messages(spark, d, registry), registry)
    entry = F.when(F.col("kind") == "entry", F.col("text"))
    party = F.when(F.col("text").like("%448 (PartyID)%"), F.col("text"))
    return lines.groupBy("seq").agg(F.count(entry).alias("n_entries"), F.min_by(entry, F.when(entry.isNotNull(), F.col("ord"))).alias("first_heading"), F.min_by(party, F.when(party.isNotNull(), F.col("ord"))).alias("first_party"))


@query("SELECT o_orderkey AS seq, '  54  required tag 54 missing' AS text FROM orders WHERE o_orderkey % 11 = 0")
def render_missing_tags(spark, d):
    m, registry = corrupt_orders(spark, d)
    return render.rendered_lines(m, registry, validate.violations(m, registry)).where("kind = 'missing'").select("seq", "text")


@query("SELECT o_orderkey AS seq, concat_ws(' ', '8 9 35 49 56 34 52 11 1 21 55', CASE WHEN o_orderkey % 11 <> 0 THEN '54' END, '60 38 40 44', CASE WHEN o_orderkey % 23 = 0 THEN '59 59' ELSE '59' END, CASE WHEN o_orderkey % 31 = 0 THEN '9999' END, '10') AS tags FROM orders")
def canonical_order(spark, d):
    m, registry = corrupt_orders(spark, d)
    return render.canonical_fields(m, registry).select("seq", F.array_join(F.transform("canonical", lambda f: f["tag"].cast("string")), " ").alias("tags"))


@query("SELECT * FROM (VALUES (1, 'TestReqID', 112, true)) AS t(depth, name, tag, required)")
def message_tree(spark, d):
    return render.message_tree(spark, Registry(), "FIX44", "TestRequest", envelope=False).select("depth", "name", F.col("tag").cast("int").alias("tag"), "required")


@query("SELECT * FROM (VALUES ('FIX42', 0, 9, 16, false), ('FIX44', 0, 9, 16, true), ('FIXT11', 0, 2, 7, false)) AS t(dict_key, zero, n_components, n_messages, selected)")
def dictionary_overview(spark, d):
    df = render.dictionary_overview(spark, Registry(), "FIX44").where("dict_key in ('FIX42', 'FIX44', 'FIXT11')")
    return df.select("dict_key", F.lit(0).alias("zero"), F.col("n_components").cast("int").alias("n_components"), F.col("n_messages").cast("int").alias("n_messages"), "selected")


@query("SELECT b.bucket, b.msg_type, b.name FROM (VALUES ('Session/Admin', '0', 'Heartbeat'), ('Session/Admin', '1', 'TestRequest'), ('Session/Admin', '2', 'ResendRequest'), ('Session/Admin', '3', 'Reject'), ('Session/Admin', '4', 'SequenceReset'), ('Session/Admin', '5', 'Logout'), ('Session/Admin', 'A', 'Logon')) AS b(bucket, msg_type, name)")
def messages_by_bucket(spark, d):
    m = Registry().table(spark, "message", ["FIXT11"]).withColumn("is_admin", F.col("category") == "admin")
    return enrich.with_bucket(m).select("bucket", "msg_type", "name")


@query(f"SELECT concat('ORD', user_id) AS order_key, CAST(row_number() OVER (ORDER BY max(event_id), concat('ORD', user_id)) AS INTEGER) AS place, count(*) AS n FROM events GROUP BY user_id")
def paged_sections(spark, d):
    records = lifecycle.order_records(keyed_events(spark, d))
    return lifecycle.paged(records).select("order_key", "place", F.col("n_messages").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["order_summary"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
