"""Which dictionary a message follows, and what the dictionary says of its fields.

Dimension tables hold definitions, a few thousand rows a dictionary; they are broadcast only while they have
at most `MOST` rows, and joined by Spark's own choice beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.functions import fields as fx
from tagstream.plans import builtin
from tagstream.sources.dictionary import Registry, normal_key

MOST = 200_000


def small(dim: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(dim) if rows <= MOST else dim


def dimension(df: DataFrame, registry: Registry, name: str) -> DataFrame:
    dim = registry.table(df.sparkSession, name)
    return small(dim, sum(len(getattr(registry, f"_{name}")(d)) for d in registry.known()))


def version_of(code: Column) -> Column:
    """The dictionary key of an application version code; null if it is none."""
    return fx.label(builtin.APPL_VERSIONS, code)


def session_key(found: Column) -> Column:
    """The two parties of a message, in one order whichever way it goes."""
    party = lambda comp, sub, place: F.struct(*[fx.first_value(found, t).alias(n) for t, n in ((comp, "comp"), (sub, "sub"), (place, "place"))])
    return F.sort_array(F.array(party(49, 50, 142), party(56, 57, 143)))


def with_session_default(messages: DataFrame, scope: str = "run") -> DataFrame:
    """`messages` and session_default: the version key that the latest earlier logon of the same session named.

    As-of, backward and strict. Only messages of the session protocol take part in the window; others get
    null by themselves. `scope` is "run" or "source": whether sessions go on across sources.
    """
    begin = fx.raw_value(F.col("raw"), 8) if "raw" in messages.columns else fx.first_value(F.col("fields"), 8)  # without tokenising twice
    session = begin == "FIXT.1.1"
    named = version_of(fx.first_value(F.col("fields"), 1137))
    keys = [F.col("source")] if scope == "source" else []
    w = Window.partitionBy(*keys, "_session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = messages.where(session).withColumn("_session", session_key(F.col("fields"))).withColumn("_named", named)
    inside = inside.withColumn("session_default", F.last_value("_named", True).over(w)).drop("_session", "_named")
    outside = messages.where(~F.coalesce(session, F.lit(False))).withColumn("session_default", F.lit(None).cast("string"))
    return inside.unionByName(outside)


def detected_key(found: Column, session_default: Column) -> Column:
    """The dictionary that a message names itself, before it is known whether there is such a one."""
    return _named_key(*[fx.first_value(found, tag) for tag in NAMING], session_default)


#: Fields that name a message's dictionary: BeginString, ApplVerID, DefaultApplVerID.
NAMING = (8, 1128, 1137)


def _named_key(begin: Column, appl: Column, default: Column, session_default: Column) -> Column:
    plain = F.replace(begin, F.lit("."), F.lit(""))
    app = F.coalesce(version_of(appl), version_of(default), session_default, F.lit("FIX50"))
    return F.when(begin.isNull(), "FIX44").when(begin == "FIXT.1.1", app).otherwise(plain)


def existing_key(key: Column, registry: Registry) -> Column:
    """Aliases resolved; keys without a dictionary become FIX44."""
    for alias, target in builtin.ALIASES.items():
        key = F.when(key == alias, target).otherwise(key) if alias not in registry.dictionaries else key
    return F.when(key.isin(*registry.keys()), key).otherwise("FIX44")


def resolve(messages: DataFrame, registry: Registry, override: str | None = None, scope: str = "run") -> DataFrame:
    """`messages` (seq, source, fields) and dict_key, fallback_key, fallback_role.

    With an override, that dictionary comes first and the detected one is the fallback, unless both are one.
    Application dictionaries from 5.0 on fall back to the session dictionary. An override without a
    dictionary is warned of in the registry and ignored.
    """
    df = messages if "session_default" in messages.columns else with_session_default(messages, scope)
    # each step names the one before it several times, so the optimiser keeps them apart and evaluates each once
    df = df.withColumns({f"_{tag}": fx.first_value(F.col("fields"), tag) for tag in NAMING})
    df = df.withColumn("_named", _named_key(*[F.col(f"_{tag}") for tag in NAMING], F.col("session_default")))
    detected = existing_key(F.col("_named"), registry)
    chosen = normal_key(override) if override else None
    if chosen is not None and builtin.ALIASES.get(chosen, chosen) not in registry.dictionaries:
        registry.warnings.append(f"no dictionary {chosen}; the detected one is used")
        chosen = None
    chosen = builtin.ALIASES.get(chosen, chosen)
    df = df.withColumn("detected_key", detected).drop("_named", *[f"_{tag}" for tag in NAMING]).withColumn("dict_key", F.lit(chosen) if chosen else F.col("detected_key"))
    session = fx.label(builtin.SESSION_FALLBACK, F.col("dict_key"))
    other = F.when(F.col("dict_key") != F.col("detected_key"), F.col("detected_key"))
    return df.withColumn("fallback_key", F.coalesce(other, session)).withColumn("fallback_role", F.when(other.isNotNull(), "DetectedOverride").when(session.isNotNull(), "Session"))


def enrich_fields(fields: DataFrame, registry: Registry) -> DataFrame:
    """Field rows (dict_key, fallback_key, tag, value, ...) and name, type, description, in_primary, in_fallback.

    The fallback is asked where the primary doesn't know a tag; where the primary lists any codes for a
    tag, only its codes count.
    """
    dim, enums = dimension(fields, registry, "field"), dimension(fields, registry, "enum")
    p = dim.select(F.col("dict_key").alias("_pk"), F.col("tag").alias("_pt"), F.col("name").alias("_pname"), F.col("type").alias("_ptype"), F.col("has_enum").alias("_penum"))
    f = dim.select(F.col("dict_key").alias("_fk"), F.col("tag").alias("_ft"), F.col("name").alias("_fname"), F.col("type").alias("_ftype"), F.col("has_enum").alias("_fenum"))
    df = fields.join(p, (F.col("dict_key") == F.col("_pk")) & (F.col("tag") == F.col("_pt")), "left").join(f, (F.col("fallback_key") == F.col("_fk")) & (F.col("tag") == F.col("_ft")), "left")
    df = df.withColumn("_ek", F.when(F.coalesce("_penum", F.lit(False)), F.col("dict_key")).otherwise(F.col("fallback_key")))
    e = enums.select(F.col("dict_key").alias("_dk"), F.col("tag").alias("_dt"), F.col("code").alias("_dc"), "description")
    df = df.join(e, (F.col("_ek") == F.col("_dk")) & (F.col("tag") == F.col("_dt")) & (F.col("value") == F.col("_dc")), "left")
    return (
        df.withColumn("name", F.coalesce("_pname", "_fname", F.col("tag").cast("string")))
        .withColumn("type", F.coalesce("_ptype", "_ftype"))
        .withColumn("in_primary", F.col("_pt").isNotNull())
        .withColumn("in_fallback", F.col("_ft").isNotNull())
        .withColumn("has_enum", F.coalesce(F.col("_penum"), F.lit(False)) | F.coalesce(F.col("_fenum"), F.lit(False)))
        .drop("_pk", "_pt", "_pname", "_ptype", "_penum", "_fk", "_ft", "_fname", "_ftype", "_fenum", "_ek", "_dk", "_dt", "_dc")
    )


def with_description(df: DataFrame, registry: Registry, tag: int, code: str, name: str) -> DataFrame:
    """`df` (dict_key, fallback_key, the column `code`) and `name`: what the dictionary says of that code of `tag`, else
    null. As in `enrich_fields`, the fallback is asked where the primary lists no codes for the tag."""
    listing = [d.key for d in registry.known() if any(row[1] == tag for row in registry._enum(d))]
    e = dimension(df, registry, "enum").where(F.col("tag") == tag)
    e = e.select(F.col("dict_key").alias("_dk"), F.col("code").alias("_dc"), F.col("description").alias(name))
    key = F.when(F.col("dict_key").isin(*listing), F.col("dict_key")).otherwise(F.col("fallback_key"))
    return df.withColumn("_key", key).join(e, (F.col("_key") == F.col("_dk")) & (F.col(code) == F.col("_dc")), "left").drop("_key", "_dk", "_dc")


def render_fields(enriched: DataFrame) -> DataFrame:
    """Enriched field rows and text: `tag (Name): value (DESCRIPTION)`, the tag to the right of four places."""
    described = F.when(F.col("description").isNotNull(), F.format_string(" (%s)", "description")).otherwise("")
    return enriched.withColumn("text", F.concat(F.format_string("%4d (%s): %s", "tag", "name", "value"), described))


def render_messages(messages: DataFrame, registry: Registry) -> DataFrame:
    """(seq, text): the rendered fields of each message, a line each."""
    rows = messages.select("seq", "dict_key", "fallback_key", F.explode("fields").alias("f")).select("seq", "dict_key", "fallback_key", "f.*")
    lines = render_fields(enrich_fields(rows, registry))
    gathered = lines.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("lines"))  # a message's own fields
    return gathered.select("seq", F.array_join(F.col("lines.text"), "\n").alias("text"))


# -- message counts


def with_message_type(messages: DataFrame, registry: Registry) -> DataFrame:
    """`messages` and msg_type (first field 35), msg_name, category, is_admin."""
    dim = dimension(messages, registry, "message")
    df = messages.withColumn("msg_type", fx.first_value(F.col("fields"), 35))
    for prefix, key in (("_p", "dict_key"), ("_f", "fallback_key")):
        side = dim.select(F.col("dict_key").alias(f"{prefix}k"), F.col("msg_type").alias(f"{prefix}t"), F.col("name").alias(f"{prefix}n"), F.col("category").alias(f"{prefix}c"))
        df = df.join(side, (F.col(key) == F.col(f"{prefix}k")) & (F.col("msg_type") == F.col(f"{prefix}t")), "left").drop(f"{prefix}k", f"{prefix}t")
    df = df.withColumn("msg_name", F.coalesce("_pn", "_fn")).withColumn("category", F.coalesce("_pc", "_fc")).drop("_pn", "_fn", "_pc", "_fc")
    return df.withColumn("is_admin", F.coalesce(F.col("category") == "admin", F.col("msg_type").isin(*builtin.ADMIN_TYPES), F.lit(False)))


def with_bucket(messages: DataFrame) -> DataFrame:
    """`messages` and bucket, bucket_order: admin messages first, then the table, then Other."""
    bucket, order = F.lit(builtin.OTHER), F.lit(len(builtin.BUCKETS))
    for i, (name, types) in reversed(list(enumerate(builtin.BUCKETS.items()))):
        hit = F.col("msg_type").isin(*types.split())
        bucket, order = F.when(hit, name).otherwise(bucket), F.when(hit, i).otherwise(order)
    admin = next(iter(builtin.BUCKETS))
    return messages.withColumn("bucket", F.when(F.col("is_admin"), admin).otherwise(bucket)).withColumn("bucket_order", F.when(F.col("is_admin"), 0).otherwise(order))


def count_messages(messages: DataFrame) -> DataFrame:
    """(msg_type, name, bucket, bucket_order, n) by type: the first name known, the latest bucket.

    messages: msg_type, msg_name, bucket, bucket_order, seq. Partial sums meet after one shuffle of a row a type.
    """
    first = F.min(F.when(F.col("msg_name").isNotNull(), F.struct("seq", "msg_name")))["msg_name"]
    last = F.max(F.struct("seq", "bucket", "bucket_order"))
    return messages.where("msg_type is not null").groupBy("msg_type").agg(F.count("*").alias("n"), first.alias("name"), last.alias("_l")).select("msg_type", "name", F.col("_l.bucket").alias("bucket"), F.col("_l.bucket_order").alias("bucket_order"), "n")


def count_report(counts: DataFrame) -> DataFrame:
    return counts.orderBy("bucket_order", "msg_type")
