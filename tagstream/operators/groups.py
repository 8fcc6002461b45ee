"""Repeating groups: one walker with three modes, and a flat explode that needs no Python.

A count field announces entries, each begun by the group's delimiter, with groups inside groups. The walker
goes once over a message's fields and yields, for each field in a group, the path of (count field, entry), and
for each fault a row. The modes differ in what may begin an entry: when validating, only the delimiter, and
a member in front of it is a fault that is stepped over; when looking for duplicates, any member; when
rendering, a member that isn't the delimiter begins the first entry only. All stop after the entries declared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.sources.dictionary import Group, Registry

VALIDATE, DUPLICATES, RENDER = "validate", "duplicates", "render"


@dataclass
class Step:
    """A field at `index` belongs to `path`; or a fault is found there."""

    index: int
    path: tuple[tuple[int, int], ...]
    rule: str | None = None
    text: str | None = None
    tag: int | None = None


def declared_count(text: str) -> int | None:
    digits = text[1:] if text[:1] == "+" else text
    return int(digits) if digits.isascii() and digits.isdigit() else None


@dataclass
class Walker:
    """Walks the fields [(tag, value), ...] of one message."""

    fields: list[tuple[int, str]]
    groups: dict[int, Group]
    level: set[int]  # tags of the message level
    mode: str = VALIDATE
    steps: list[Step] = field(default_factory=list)

    def walk(self) -> list[Step]:
        members = set(_members(self.groups))
        i = 0
        while i < len(self.fields):
            tag = self.fields[i][0]
            self.steps.append(Step(i, ()))
            if tag in self.groups:
                i = self._group(i, self.groups[tag], ())
                continue
            if self.mode == VALIDATE and tag in members and tag not in self.level:
                self._fault(i, (), "group_member_outside", f"tag {tag} outside its group")
            i += 1
        return self.steps

    def _fault(self, i: int, path: tuple, rule: str, text: str, tag: int | None = None) -> None:
        if self.mode == VALIDATE:
            at = min(i, len(self.fields) - 1)
            self.steps.append(Step(at, path, rule, text, tag if tag is not None else self.fields[at][0]))

    def _group(self, i: int, g: Group, path: tuple) -> int:
        count = declared_count(self.fields[i][1])
        if count is None:
            self._fault(i, path, "group_bad_count", f"group {g.count_tag}: bad count {self.fields[i][1]}")
        wanted, found, at = count or 0, 0, i + 1
        while found < wanted and at < len(self.fields):
            tag = self.fields[at][0]
            if tag != g.delimiter:
                if tag not in g.members:
                    break
                if self.mode == VALIDATE:
                    self._fault(at, path, "group_before_delimiter", f"group {g.count_tag}: tag {tag} before delimiter {g.delimiter}")
                    at += 1
                    continue
                if self.mode == RENDER and found:
                    self.steps.append(Step(at, path))
                    at += 1
                    continue
            found += 1
            at = self._entry(at, g, (*path, (g.count_tag, found)))
        if count is not None and found != wanted:
            self._fault(i, path, "group_count_mismatch", f"group {g.count_tag}: declared {wanted}, found {found}")
        return at

    def _entry(self, at: int, g: Group, path: tuple) -> int:
        begin, last, seen = at, -1, set()
        while at < len(self.fields):
            tag = self.fields[at][0]
            if tag not in g.members or (tag == g.delimiter and at > begin):
                break
            place = g.members.index(tag)
            if place < last:
                self._fault(at, path, "group_out_of_order", f"group {g.count_tag}: tag {tag} out of order")
            last = place
            seen.add(tag)
            self.steps.append(Step(at, path))
            at = self._group(at, g.nested[tag], path) if tag in g.nested else at + 1
        for tag in g.required:
            if tag not in seen:
                self._fault(begin, path, "group_required", f"group {g.count_tag}: required tag {tag} missing", tag)
        return at


def _members(groups: dict[int, Group]) -> Iterator[int]:
    for g in groups.values():
        yield from g.members
        yield from _members(g.nested)


def path_text(path: tuple) -> str:
    return "/".join(f"{tag}[{entry}]" for tag, entry in path)


STEPS = "seq bigint, pos int, tag bigint, value string, path string, depth int, count_tag bigint, entry int, rule string, text string, rule_tag bigint"


def walk_groups(messages: DataFrame, registry: Registry, mode: str = VALIDATE, only_groups: bool = False) -> DataFrame:
    """A row a field and a row a fault of each message (seq, dict_key, msg_type, fields), in batches.

    The specifications of groups are definitions, shared with the tasks once. Messages whose type no
    dictionary describes are walked without groups.
    """
    specs = {(d.key, m.msg_type): (d.groups(m), {tag for tag, _ in d.order(m)}) for d in registry.known() for m in d.messages}
    shared = messages.sparkSession.sparkContext.broadcast(specs)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in STEPS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for seq, key, kind, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                groups, level = shared.value.get((key, kind), ({}, set()))
                if only_groups and not any(x["tag"] in groups for x in found):
                    continue
                for s in Walker([(x["tag"], x["value"]) for x in found], groups, level, mode).walk():
                    if only_groups and not s.path and s.rule is None:
                        continue
                    x = found[s.index]
                    count_tag, entry = s.path[-1] if s.path else (None, None)
                    rows.append((seq, x["pos"], x["tag"], x["value"], path_text(s.path), len(s.path), count_tag, entry, s.rule, s.text, s.tag))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return messages.select("seq", "dict_key", "msg_type", "fields").mapInArrow(f, STEPS)


RULE_ROWS = "seq bigint, rule string, tag bigint, pos int, text string"


def walk_rules(messages: DataFrame, registry: Registry) -> DataFrame:
    """(seq, rule, tag, pos, text): faults of groups and repeated tags, from one pass over each message's fields.

    Known types (msg_name): a tag is repeated twice at the message level, or twice in one entry of a group. Other
    types: twice anywhere, unless a group of some dictionary repeats it. Counted within the message; no shuffle.
    """
    specs = {(d.key, m.msg_type): (d.groups(m), {tag for tag, _ in d.order(m)}) for d in registry.known() for m in d.messages}
    repeatable = {tag for found, _ in specs.values() for tag in [*_members(found), *found]}
    shared = messages.sparkSession.sparkContext.broadcast((specs, repeatable))  # definitions

    def faults(key: str, kind: str, known: bool, pos: list, tags: list, values: list) -> Iterator[tuple]:
        specs, repeatable = shared.value
        own, level = specs.get((key, kind), ({}, set()))
        found = list(zip(tags, values, strict=True))
        if own:
            for s in Walker(found, own, level, VALIDATE).walk():
                if s.rule is not None:
                    yield s.rule, s.tag, pos[s.index], s.text
        if known and own and not own.keys().isdisjoint(tags):
            steps = [(s.path, s.index) for s in Walker(found, own, level, DUPLICATES).walk()]
        elif len(set(tags)) == len(tags):
            return
        else:
            steps = [((), i) for i in range(len(tags))]
        seen = set()
        for path, i in steps:
            if (path, tags[i]) not in seen:
                seen.add((path, tags[i]))
            elif known or tags[i] not in repeatable:
                yield "duplicate_tag", tags[i], pos[i], f"duplicate tag {tags[i]}"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*((c.split()[0], {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]]) for c in RULE_ROWS.split(", ")), strict=True)
        for batch in batches:
            found = batch.column(4).flatten()
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(4)), 0)))
            pos, tags, values = (found.field(n).to_pylist() for n in ("pos", "tag", "value"))
            rows, at = [], 0
            for seq, key, kind, known, end in zip(*(batch.column(i).to_pylist() for i in range(4)), ends.tolist(), strict=True):
                rows += [(seq, *x) for x in faults(key, kind, known, pos[at:end], tags[at:end], values[at:end])]
                at = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    return messages.select("seq", "dict_key", "msg_type", F.col("msg_name").isNotNull().alias("known"), "fields").mapInArrow(f, RULE_ROWS)


def explode_flat_group(messages: DataFrame, count_tag: int, delimiter: int, members: list[int], *keys: str) -> DataFrame:
    """(keys, entry, entry_fields): one row an entry of a group without groups inside. No shuffle, no Python.

    Entries begin at the delimiter and end before the next one or the first field that is no member. As many as the
    count declares are taken. Each step is a column of its own that later ones name several times, so the optimiser
    keeps it apart and nothing is evaluated again for each entry.
    """
    begin_at = F.array_position(F.transform("fields", lambda f: f["tag"]), count_tag).cast("int")
    df = messages.select(*keys, "fields", begin_at.alias("_at")).where("_at > 0")
    declared = F.try_element_at("fields", F.col("_at"))["value"].try_cast("int")
    df = df.select(*keys, F.slice("fields", F.col("_at") + 1, F.size("fields")).alias("_rest"), F.coalesce(declared, F.lit(0)).alias("_declared"))
    df = df.withColumn("_outside", F.array_position(F.transform("_rest", lambda f: f["tag"].isin(*members)), False).cast("int"))
    df = df.withColumn("_run", F.when(F.col("_outside") > 0, F.slice("_rest", F.lit(1), F.col("_outside") - 1)).otherwise(F.col("_rest")))
    df = df.withColumn("_begins", F.filter(F.transform("_run", lambda f, i: F.when(f["tag"] == delimiter, i + 1)), lambda i: i.isNotNull()))
    df = df.where((F.size("_begins") > 0) & (F.col("_declared") > 0))
    df = df.withColumn("_ends", F.concat(F.slice("_begins", F.lit(2), F.size("_begins")), F.array(F.size("_run") + 1)))
    cuts = F.slice(F.arrays_zip(F.col("_begins").alias("b"), F.col("_ends").alias("e")), F.lit(1), F.least("_declared", F.size("_begins")))
    rows = df.select(*keys, "_run", F.posexplode(cuts).alias("_i", "_cut"))
    return rows.select(*keys, (F.col("_i") + 1).alias("entry"), F.slice("_run", F.col("_cut.b"), F.col("_cut.e") - F.col("_cut.b")).alias("entry_fields"))
