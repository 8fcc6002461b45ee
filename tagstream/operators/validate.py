"""Validation: each rule gives rows (seq, ord, rule, tag, pos, text); a message without rows is clean.

messages: seq, raw, fields, dict_key, fallback_key, fallback_role, msg_type, msg_name. Rules over single
messages are expressions on the field array, or a walk over it, and need no shuffle; rules over dictionaries explode
the fields and join dimension tables. `ord` is the rule's place in a report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagstream.functions import fields as fx
from tagstream.operators import groups
from tagstream.operators.enrich import dimension, enrich_fields, small
from tagstream.operators.shared import materialize
from tagstream.sources.dictionary import Registry

RULES = [
    "msg_type",
    "duplicate_tag",
    "body_length",
    "unknown_tag",
    "not_in_detected",
    "enum",
    "type",
    "required",
    "out_of_order",
    "group_bad_count",
    "group_before_delimiter",
    "group_count_mismatch",
    "group_out_of_order",
    "group_required",
    "group_member_outside",
    "checksum",
]
COLUMNS = ["seq", "ord", "rule", "tag", "pos", "text"]
FAULT = "struct<ord:int,rule:string,tag:bigint,pos:int,text:string>"


def violation(rule: str | Column, tag: Column | int | None, pos: Column | None, text: Column | str) -> list[Column]:
    """The columns of a violation row, behind seq."""
    name = F.lit(rule) if isinstance(rule, str) else rule
    order = F.lit(RULES.index(rule)) if isinstance(rule, str) else fx.label({r: str(i) for i, r in enumerate(RULES)}, rule)
    tag = F.lit(tag) if not isinstance(tag, Column) else tag
    return [order.cast("int").alias("ord"), name.alias("rule"), tag.cast("bigint").alias("tag"), (F.lit(None) if pos is None else pos).cast("int").alias("pos"), (F.lit(text) if isinstance(text, str) else text).alias("text")]


def _when(condition: Column, rule: str, tag: Column | int, pos: Column | None, text: Column | str) -> Column:
    return F.when(condition, F.struct(*violation(rule, tag, pos, text)))


def message_rules(messages: DataFrame, registry: Registry) -> DataFrame:
    """Rules over one message, as one array of faults: its type, its length and checksum, the tags of the message
    level that its type requires, and known tags whose place in the type's order is before that of the known tag in
    front of them (fields inside groups have no place of their own)."""
    dim = dimension(messages, registry, "order").select(F.col("dict_key").alias("_k"), F.col("msg_type").alias("_t"), "tag", "ord", "required")
    need, place = F.collect_list(F.when(F.col("required"), F.col("tag"))), F.map_from_entries(F.collect_list(F.struct("tag", "ord")))
    lists = small(dim.groupBy("_k", "_t").agg(need.alias("_need"), place.alias("_place")), sum(len(d.messages) for d in registry.known()))  # a type's definition
    df = messages.join(lists, (F.col("dict_key") == F.col("_k")) & (F.col("msg_type") == F.col("_t")), "left")
    df = df.withColumn("_tags", F.transform("fields", lambda f: f["tag"]))
    placed = F.filter(F.transform("fields", lambda f: F.struct(f["pos"].alias("pos"), f["tag"].alias("tag"), F.col("_place")[f["tag"]].alias("ord"))), lambda f: f["ord"].isNotNull())
    df = df.withColumn("_known", F.when(F.col("_place").isNotNull(), placed))

    missing, unknown = F.col("msg_type").isNull(), F.col("msg_name").isNull()
    kind = _when(missing | unknown, "msg_type", 35, None, F.when(missing, "message type missing").otherwise(F.concat(F.lit("unknown message type "), F.col("msg_type"))))
    error = lambda e, rule, tag: F.transform(F.array(e), lambda x: _when(x.isNotNull(), rule, tag, None, x))  # noqa: E731  named once, evaluated once
    errors = [error(fx.body_length_error(F.col("raw"), F.col("fields")), "body_length", 9), error(fx.checksum_error(F.col("raw"), F.col("fields")), "checksum", 10)]
    gone = F.transform(F.array_except("_need", "_tags"), lambda t: F.struct(*violation("required", t, None, F.concat(F.lit("required tag "), t.cast("string"), F.lit(" missing")))))
    wrong = F.transform("_known", lambda f, i: _when((i > 0) & (f["ord"] < F.get("_known", i - 1)["ord"]), "out_of_order", f["tag"], f["pos"], F.concat(F.lit("tag "), f["tag"].cast("string"), F.lit(" out of order"))))
    none = F.array().cast(f"array<{FAULT}>")
    parts = [F.coalesce(p.cast(f"array<{FAULT}>"), none) for p in (F.array(kind), *errors, gone, wrong)]
    found = F.filter(F.concat(*parts), lambda v: v.isNotNull())
    return df.select("seq", F.explode(found).alias("v")).select("seq", "v.*")


def _enriched(messages: DataFrame, registry: Registry) -> DataFrame:
    rows = messages.select("seq", "dict_key", "fallback_key", "fallback_role", F.explode("fields").alias("f")).select("seq", "dict_key", "fallback_key", "fallback_role", "f.*")
    return enrich_fields(rows, registry)


def field_rules(messages: DataFrame, registry: Registry) -> DataFrame:
    """Unknown tags, tags that the detected dictionary lacks, codes that aren't listed, values of another type."""
    e = _enriched(messages, registry).withColumn("_known", F.col("in_primary") | F.col("in_fallback"))
    both = F.when(F.col("fallback_key").isNotNull(), F.concat_ws(" or ", "dict_key", "fallback_key")).otherwise(F.col("dict_key"))
    tag = F.col("tag").cast("string")
    checks = [
        (~F.col("_known"), "unknown_tag", F.concat(F.lit("unknown tag "), tag, F.lit(" in "), both)),
        (F.col("in_primary") & ~F.col("in_fallback") & (F.col("fallback_role") == "DetectedOverride"), "not_in_detected", F.concat(F.lit("tag "), tag, F.lit(" is not in "), F.col("fallback_key"))),
        (F.col("_known") & F.col("has_enum") & F.col("description").isNull(), "enum", F.concat(F.lit("tag "), tag, F.lit(": value "), F.col("value"), F.lit(" is not listed"))),
        (F.col("_known") & ~fx.type_allows(F.col("type"), F.col("value")), "type", F.concat(F.lit("tag "), tag, F.lit(": "), F.col("value"), F.lit(" is no "), F.upper("type"))),
    ]
    found = F.array(*[F.when(when, F.struct(*violation(rule, F.col("tag"), F.col("pos"), text))) for when, rule, text in checks])
    return e.select("seq", F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v")).select("seq", "v.*")


def walked_rules(messages: DataFrame, registry: Registry) -> DataFrame:
    """Faults of groups, tags outside their group, and repeated tags."""
    return groups.walk_rules(messages, registry).select("seq", *violation(F.col("rule"), F.col("tag"), F.col("pos"), F.col("text")))


def violations(messages: DataFrame, registry: Registry) -> DataFrame:
    """All rules' rows, in no order.

    The messages are written to the shared folder, so that each of the three passes reads them tokenised and resolved.
    """
    names = ["seq", "raw", "fields", "dict_key", "fallback_key", "fallback_role", "msg_type", "msg_name"]
    messages = materialize(messages.select(*names), "messages")
    parts = [message_rules(messages, registry), field_rules(messages, registry), walked_rules(messages, registry)]
    return reduce(DataFrame.unionByName, (p.select(*COLUMNS) for p in parts))


def reasons(found: DataFrame) -> DataFrame:
    """(seq, reason): a message's distinct texts in report order, joined."""
    rows = found.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("pos", F.lit(0)).alias("p"), F.coalesce("tag", F.lit(0)).alias("t"), "text"))).alias("all"))
    return rows.select("seq", F.array_join(F.array_distinct(F.col("all.text")), "; ").alias("reason"))


def invalid(messages: DataFrame, found: DataFrame) -> DataFrame:
    """The messages that have violations."""
    return messages.join(found.select("seq").distinct(), "seq", "left_semi")
