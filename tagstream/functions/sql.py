"""The engine's functions by name in SQL.

Scalar ones have SQL bodies made from the Column expressions' own rules, so Catalyst inlines them; the walker of
groups and the validator are Python table functions over one message.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tagstream.functions import fields as fx
from tagstream.operators.groups import VALIDATE, Walker, path_text
from tagstream.sources.dictionary import Registry

_MESSAGE = fx.MESSAGE
_BEFORE = r"(?s)^(.*\x01)10="


def _labels(labels: dict[str, str], code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


FUNCTIONS = {
    "fix_extract": ("line STRING", "ARRAY<STRING>", f"regexp_extract_all(line, r'{_MESSAGE}', 0)"),
    "fix_tag": ("raw STRING, tag BIGINT", "STRING", r"CASE WHEN instr(concat(chr(1), raw), concat(chr(1), tag, '=')) > 0 THEN regexp_extract(concat(chr(1), raw), concat(r'\x01', tag, r'=([^\x01]*)'), 1) END"),
    "fix_fields": ("raw STRING", "ARRAY<STRUCT<tag: BIGINT, value: STRING>>", r"transform(filter(split(raw, r'\x01'), f -> f rlike '^[+]?[0-9]{1,10}='), f -> named_struct('tag', CAST(substring_index(f, '=', 1) AS BIGINT), 'value', substr(f, instr(f, '=') + 1)))"),
    "fix_checksum": ("raw STRING", "STRING", f"CASE WHEN regexp_extract(raw, r'{_BEFORE}', 1) <> '' THEN lpad(CAST(aggregate(split(regexp_extract(raw, r'{_BEFORE}', 1), ''), 0L, (s, c) -> s + ascii(c)) % 256 AS STRING), 3, '0') END"),
    "fix_body_length": ("raw STRING", "INT", rf"CASE WHEN raw rlike r'{fx._LENGTH}' THEN octet_length(regexp_extract(raw, r'{fx._LENGTH}', 1)) END"),
    "fix_state": ("status STRING, exec_type STRING, ack STRING, leaves STRING", "STRING", f"coalesce({_labels(fx.ORDER_STATUS, 'status')}, {_labels(fx.EXEC_TYPE, 'exec_type')}, {_labels(fx.EXEC_ACK, 'ack')}, CASE WHEN leaves = '0' THEN 'Filled' END, 'Unknown')"),
}


def register(spark: SparkSession, registry: Registry | None = None) -> list[str]:
    """Make the functions of this session; returns their names."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    registry = registry or Registry()
    specs = {(d.key, m.msg_type): (d.groups(m), {tag for tag, _ in d.order(m)}) for d in registry.known() for m in d.messages}

    def steps(raw: str, key: str):
        found = []
        for fragment in (raw or "").split(fx.SOH):
            tag, eq, value = fragment.partition("=")
            if eq and tag.isascii() and tag.isdigit() and int(tag) <= fx.LARGEST_TAG:
                found.append((int(tag), value))
        kind = next((v for t, v in found if t == 35), None)
        groups, level = specs.get((key, kind), ({}, set()))
        return found, Walker(found, groups, level, VALIDATE).walk()

    @udtf(returnType="pos: int, tag: bigint, value: string, path: string")
    class Groups:
        def eval(self, raw: str, key: str):
            found, walked = steps(raw, key)
            for s in walked:
                if s.rule is None:
                    yield s.index + 1, *found[s.index], path_text(s.path)

    @udtf(returnType="rule: string, tag: bigint, text: string")
    class Faults:
        def eval(self, raw: str, key: str):
            for s in steps(raw, key)[1]:
                if s.rule is not None:
                    yield s.rule, s.tag, s.text

    spark.udtf.register("fix_groups", Groups)
    spark.udtf.register("fix_validate", Faults)
    return [*FUNCTIONS, "fix_groups", "fix_validate"]
