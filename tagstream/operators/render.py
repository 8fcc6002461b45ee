"""Messages as text for people: groups with headings and indents, what is wrong beside it, canonical field order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.functions import fields as fx
from tagstream.operators import enrich, groups
from tagstream.sources.dictionary import Registry

#: The fields that lead a message, in this order.
LEADING = (8, 9, 35, 49, 56, 34, 52)


def rendered_lines(messages: DataFrame, registry: Registry, violations: DataFrame | None = None) -> DataFrame:
    """(seq, ord, kind, text): a line a field; a heading before each entry of a group; the faults of a tag behind its
    line; and, at the end, a line for each tag with a fault that the message lacks, by tag.

    messages: seq, dict_key, fallback_key, msg_type, fields.
    """
    steps = groups.walk_groups(messages, registry, groups.RENDER)
    keyed = steps.join(messages.select("seq", "dict_key", "fallback_key"), "seq")
    named = enrich.render_fields(enrich.enrich_fields(keyed.drop("text", "rule", "rule_tag"), registry))
    indent = F.repeat(F.lit("    "), F.col("depth"))
    w = Window.partitionBy("seq").orderBy("pos")
    # an entry begins where its path is new: neither that of the field in front nor one that leads on from it
    before = F.lag("path", 1, "").over(w)
    fresh = (F.col("path") != "") & ~F.startswith(F.concat(before, F.lit("/")), F.concat(F.col("path"), F.lit("/")))
    titles = enrich.dimension(messages, registry, "field").select(F.col("dict_key").alias("_k"), F.col("tag").alias("_t"), fx.group_title(F.col("name")).alias("title"))
    rows = named.withColumn("fresh", fresh).join(titles, (F.col("dict_key") == F.col("_k")) & (F.col("count_tag") == F.col("_t")), "left")
    if violations is not None:
        faults = violations.where("tag is not null").groupBy("seq", F.col("tag")).agg(F.array_join(F.array_distinct(F.sort_array(F.collect_list("text"))), "; ").alias("faults"))
        first = F.row_number().over(Window.partitionBy("seq", "tag").orderBy("pos")) == 1
        rows = rows.withColumn("_first", first).join(faults, ["seq", "tag"], "left").withColumn("faults", F.when(F.col("_first"), F.col("faults")))
    else:
        faults, rows = None, rows.withColumn("faults", F.lit(None).cast("string"))
    heading = F.when(F.col("fresh"), F.struct((F.col("pos") * 2).alias("ord"), F.lit("entry").alias("kind"), F.concat(F.repeat(F.lit("    "), F.col("depth") - 1), F.lit("  "), F.col("title"), F.lit(" "), F.col("entry").cast("string")).alias("text")))
    line = F.struct((F.col("pos") * 2 + 1).alias("ord"), F.lit("field").alias("kind"), F.concat(indent, F.col("text"), F.coalesce(F.concat(F.lit("  "), F.col("faults")), F.lit(""))).alias("text"))
    out = rows.select("seq", F.explode(F.filter(F.array(heading, line), lambda x: x.isNotNull())).alias("x")).select("seq", "x.*")
    if faults is None:
        return out
    absent = faults.join(messages.select("seq", F.transform("fields", lambda f: f["tag"]).alias("_tags")), "seq").where(~F.array_contains("_tags", F.col("tag")))
    last = absent.select("seq", (F.lit(1 << 30) + F.row_number().over(Window.partitionBy("seq").orderBy("tag"))).cast("int").alias("ord"), F.lit("missing").alias("kind"), F.format_string("%4d  %s", "tag", "faults").alias("text"))
    return out.unionByName(last)


def canonical_fields(messages: DataFrame, registry: Registry) -> DataFrame:
    """`messages` with canonical, their fields in the order leading fields, the type's own, others, trailer.

    Fields with one place keep the order they have. An expression on the array; no shuffle.
    """
    dim = enrich.dimension(messages, registry, "order")
    lists = dim.groupBy(F.col("dict_key").alias("_k"), F.col("msg_type").alias("_t")).agg(F.map_from_entries(F.collect_list(F.struct("tag", "ord"))).alias("_place"))
    df = messages.join(F.broadcast(lists), (F.col("dict_key") == F.col("_k")) & (F.col("msg_type") == F.col("_t")), "left")

    def place(tag: Column) -> Column:
        leading = F.array_position(F.array(*[F.lit(t).cast("bigint") for t in LEADING]), tag).cast("int")
        return F.when(leading > 0, leading).when(tag.isin(93, 89, 10), F.lit(1 << 29) - F.when(tag == 93, 2).when(tag == 89, 1).otherwise(0)).otherwise(F.lit(100) + F.coalesce(F.col("_place")[tag], F.lit(1 << 20)))

    placed = F.transform("fields", lambda f: F.struct(place(f["tag"]).cast("int").alias("at"), f["pos"].alias("pos"), f["tag"].alias("tag"), f["value"].alias("value")))
    ordered = F.transform(F.array_sort(placed), lambda f: F.struct(f["pos"].alias("pos"), f["tag"].alias("tag"), f["value"].alias("value")))
    return df.withColumn("canonical", ordered).drop("_k", "_t", "_place")


def dictionary_overview(spark, registry: Registry, selected: str | None = None) -> DataFrame:
    """(dict_key, n_fields, n_components, n_messages, selected); header and trailer count as components."""
    count = lambda name, column: registry.table(spark, name).groupBy("dict_key").agg(F.countDistinct(column).alias("n"))
    fields, messages = count("field", "tag").withColumnRenamed("n", "n_fields"), count("message", "name").withColumnRenamed("n", "n_messages")
    tree = registry.table(spark, "tree")
    named = F.when(F.col("kind") == "component", F.col("name"))
    parts = tree.groupBy("dict_key").agg((F.countDistinct(named) + F.countDistinct(F.when(F.col("root").isin("Header", "Trailer"), F.col("root")))).alias("n_components"))
    df = fields.join(messages, "dict_key", "left").join(parts, "dict_key", "left")
    return df.select("dict_key", "n_fields", F.coalesce("n_components", F.lit(0)).alias("n_components"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"), (F.col("dict_key") == F.lit(selected)).alias("selected"))


def message_tree(spark, registry: Registry, key: str, name: str, envelope: bool = True) -> DataFrame:
    """(path, depth, kind, name, tag, required, enums) of a message by name, else by type, in document order.

    `envelope` keeps what the header and trailer hold. Field 35 lists the message's own type only.
    """
    d = registry.browsable(key)
    found = next((m for m in d.messages if m.name == name), None) or next((m for m in d.messages if m.msg_type == name), None)
    if found is None:
        raise ValueError(f"no message {name} in {d.key}")
    tree = registry.table(spark, "tree", [key]).where(F.col("root") == found.name)
    if not envelope:
        first, last = len(d.header), len(d.header) + len(found.entries)
        tree = tree.where((F.col("path")[0] >= first) & (F.col("path")[0] < last))
    codes = registry.table(spark, "enum", [key]).where((F.col("tag") != 35) | (F.col("code") == found.msg_type))
    enums = codes.groupBy(F.col("tag").alias("_t")).agg(F.sort_array(F.collect_list(F.concat_ws("=", "code", "description"))).alias("enums"))
    return tree.join(enums, F.col("tag") == F.col("_t"), "left").drop("_t", "root", "dict_key").orderBy("path")
