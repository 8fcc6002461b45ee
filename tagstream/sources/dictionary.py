"""Versioned message dictionaries: compact built-ins and XML files, flattened to small dimension tables.

Parsing and flattening are driver work over definitions of a few thousand rows. The tables say what a query
needs: names and types, enum codes, messages, field order, required fields, groups, and the expanded tree.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tagstream.plans import builtin


@dataclass
class Entry:
    """One thing a container holds: a field, a component or a group with entries of its own."""

    kind: str
    name: str
    required: bool
    entries: list[Entry] = field(default_factory=list)


@dataclass
class FieldDef:
    tag: int
    name: str
    type: str
    enums: dict[str, str] = field(default_factory=dict)


@dataclass
class MessageDef:
    name: str
    msg_type: str
    category: str
    entries: list[Entry]


@dataclass
class Group:
    count_tag: int
    name: str
    delimiter: int
    members: list[int]
    required: list[int]
    nested: dict[int, Group]


@dataclass
class Dictionary:
    key: str
    fields: dict[str, FieldDef]
    components: dict[str, list[Entry]]
    messages: list[MessageDef]
    header: list[Entry]
    trailer: list[Entry]
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.by_tag = {f.tag: f for f in self.fields.values()}

    def tag(self, name: str) -> int | None:
        f = self.fields.get(name)
        return f.tag if f else None

    def expand(self, entries: list[Entry], stack: tuple[str, ...] = ()) -> Iterator[Entry]:
        """Entries with components inlined; a component inside itself is skipped."""
        for e in entries:
            if e.kind != "component":
                yield e
            elif e.name in stack:
                self.warnings.append(f"component {e.name} contains itself")
            else:
                yield from self.expand(self.components.get(e.name, []), (*stack, e.name))

    def body(self, message: MessageDef) -> list[Entry]:
        return [*self.header, *message.entries, *self.trailer]

    def order(self, message: MessageDef) -> list[tuple[int, bool]]:
        """(tag, required) of the message level, in order, each tag once; a group stands as its count."""
        found: dict[int, bool] = {}
        for e in self.expand(self.body(message)):
            tag = self.tag(e.name)
            if tag is not None:
                found[tag] = found.get(tag, False) or e.required
        return list(found.items())

    def group(self, e: Entry, stack: tuple[str, ...] = ()) -> Group | None:
        count = self.tag(e.name)
        if count is None or e.name in stack:
            return None
        members, required, nested = [], [], {}
        for child in self.expand(e.entries):
            tag = self.tag(child.name)
            if tag is None or tag in members:
                continue
            members.append(tag)
            if child.required:
                required.append(tag)
            if child.kind == "group" and (inner := self.group(child, (*stack, e.name))):
                nested[tag] = inner
        return Group(count, e.name, members[0] if members else count, members, required, nested)

    def groups(self, message: MessageDef) -> dict[int, Group]:
        """Count tag to group, at the message level, header and trailer included."""
        found = (self.group(e) for e in self.expand(self.body(message)) if e.kind == "group")
        return {g.count_tag: g for g in found if g}

    def tree(self, root: str, entries: list[Entry], path: tuple[int, ...] = (), stack: tuple[str, ...] = ()) -> Iterator[tuple]:
        """(root, path, depth, kind, name, tag, required) of everything below a message or component."""
        for i, e in enumerate(entries):
            at = (*path, i)
            yield root, at, len(at), e.kind, e.name, self.tag(e.name) if e.kind != "component" else None, e.required
            if e.kind == "group":
                yield from self.tree(root, e.entries, at, stack)
            elif e.kind == "component" and e.name not in stack:
                yield from self.tree(root, self.components.get(e.name, []), at, (*stack, e.name))


# -- reading


def key_of(kind: str, major: str, minor: str, service_pack: str = "") -> str:
    return f"{kind}{major}{minor}" + (f"SP{service_pack}" if service_pack not in ("", "0", None) else "")


def normal_key(text: str) -> str:
    """A dictionary key as a user may write it: 4.4, fix.4.4, FIX44."""
    key = text.replace(".", "").upper()
    return key if key.startswith("FIX") else f"FIX{key}"


def _ascii(text: str) -> str:
    return re.sub(r"[^\x00-\x7F]", "?", text or "")


def _entries(node) -> list[Entry]:
    return [Entry(c.tag, _ascii(c.get("name")), c.get("required") == "Y", _entries(c) if c.tag == "group" else []) for c in node if c.tag in ("field", "group", "component")]


def from_xml(text: str) -> Dictionary:
    """A dictionary from XML with the sections fields, messages, components, header and trailer."""
    root = ET.fromstring(text)
    parts = {name: root.find(name) for name in ("fields", "messages", "components", "header", "trailer")}
    if missing := [n for n, p in parts.items() if p is None]:
        raise ValueError(f"dictionary lacks {', '.join(missing)}")
    fields = {}
    for f in parts["fields"].findall("field"):
        values = [v for v in f.iter("value")]
        name = _ascii(f.get("name"))
        fields[name] = FieldDef(int(f.get("number")), name, _ascii(f.get("type")), {_ascii(v.get("enum")): _ascii(v.get("description")) for v in values})
    messages = [MessageDef(_ascii(m.get("name")), _ascii(m.get("msgtype")), _ascii(m.get("msgcat")), _entries(m)) for m in parts["messages"].findall("message")]
    components = {_ascii(c.get("name")): _entries(c) for c in parts["components"].findall("component")}
    key = key_of(root.get("type", "FIX"), root.get("major", ""), root.get("minor", ""), root.get("servicepack", ""))
    return Dictionary(key, fields, components, messages, _entries(parts["header"]), _entries(parts["trailer"]))


def _contents(text: str) -> list[Entry]:
    out: list[list[Entry]] = [[]]
    for word in text.split():
        if word == "(":
            out[-1][-1].kind = "group"
            out.append(out[-1][-1].entries)
        elif word == ")":
            out.pop()
        else:
            name = word.strip("@!")
            out[-1].append(Entry("component" if word.startswith("@") else "field", name, word.endswith("!")))
    return out[0]


def _fields(text: str) -> dict[str, FieldDef]:
    found = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        tag, name, kind, *enums = line.split()
        found[name] = FieldDef(int(tag), name, kind, dict(e.split("=", 1) for e in enums))
    return found


def compact(key: str, fields: str, components: str, messages: str, header: str, trailer: str) -> Dictionary:
    """A dictionary from the compact notation of the built-ins."""
    lines = lambda text: filter(None, map(str.strip, text.splitlines()))
    made = []
    for line in lines(messages):
        head, _, body = line.partition(":")
        msg_type, category, name = head.split()
        made.append(MessageDef(name, msg_type, category, _contents(body)))
    groups = {n.strip(): _contents(body) for n, _, body in (line.partition(":") for line in lines(components))}
    return Dictionary(key, _fields(fields), groups, made, _contents(header), _contents(trailer))


def _message_types(d: Dictionary) -> Dictionary:
    """Field 35 lists the dictionary's own messages."""
    d.fields["MsgType"] = FieldDef(35, "MsgType", "STRING", {m.msg_type: re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", m.name).upper() for m in d.messages})
    d.__post_init__()
    return d


def builtin_dictionaries() -> dict[str, Dictionary]:
    found = {}
    for key, (version, logon, own) in builtin.BUILTIN.items():
        assert key_of(*version) == key
        session = builtin.SESSION_MESSAGES.format(logon=logon) if logon is not None else ""
        app = builtin.ORDER_MESSAGES if key != "FIXT11" else ""
        extra = "OrderID! ExecTransType!" if key == "FIX42" else "OrderID!"
        fields = (builtin.COMMON_FIELDS if logon is not None else "") + (builtin.ORDER_FIELDS if app else "") + own
        if key.startswith("FIX50"):  # text and identifiers that application messages use
            fields += "\n58 Text STRING"
        head, tail = (builtin.HEADER, builtin.TRAILER) if logon is not None else ("", "")
        if key == "FIXT11":
            head += " ApplVerID"
        found[key] = _message_types(compact(key, fields, builtin.COMPONENTS if app else "", session + app.replace("ExecutionReport: OrderID!", f"ExecutionReport: {extra}"), head, tail))
    return found


def with_session_envelope(d: Dictionary, session: Dictionary) -> Dictionary:
    """A 5.0 dictionary without header and trailer of its own takes those of the session dictionary."""
    if d.header or d.trailer or not d.key.startswith("FIX5"):
        return d
    fields = {**{n: f for n, f in session.fields.items() if n not in d.fields and any(e.name == n for e in [*session.expand(session.header), *session.expand(session.trailer)])}, **d.fields}
    return Dictionary(d.key, fields, {**session.components, **d.components}, d.messages, session.header, session.trailer, d.warnings)


# -- the registry and its tables


@dataclass
class Registry:
    """All dictionaries by key. Custom ones replace built-ins of the same key; the last one wins."""

    dictionaries: dict[str, Dictionary] = field(default_factory=builtin_dictionaries)
    custom: set[str] = field(default_factory=set)
    warnings: list[str] = field(default_factory=list)

    def add_xml(self, text: str) -> str:
        d = from_xml(text)
        if d.key in self.custom:
            self.warnings.append(f"dictionary {d.key} was given twice; the last one counts")
        elif d.key in self.dictionaries:
            self.warnings.append(f"dictionary {d.key} replaces the built-in one")
        self.dictionaries[d.key] = with_session_envelope(d, self.dictionaries["FIXT11"])
        self.custom.add(d.key)
        return d.key

    def keys(self) -> list[str]:
        return sorted(self.dictionaries)

    def resolve(self, key: str) -> Dictionary:
        key = builtin.ALIASES.get(key, key)
        return self.dictionaries.get(key, self.dictionaries["FIX44"])

    def browsable(self, key: str) -> Dictionary:
        return with_session_envelope(self.resolve(key), self.dictionaries["FIXT11"])

    def known(self, keys: list[str] | None = None) -> list[Dictionary]:
        return [self.browsable(k) for k in (keys or self.keys())]

    # each table has a few thousand rows at most: definitions, not data
    def table(self, spark: SparkSession, name: str, keys: list[str] | None = None) -> DataFrame:
        rows = [r for d in self.known(keys) for r in getattr(self, f"_{name}")(d)]
        return spark.createDataFrame(rows, SCHEMAS[name])

    @staticmethod
    def _field(d):
        return [(d.key, f.tag, f.name, f.type, bool(f.enums)) for f in d.by_tag.values()]

    @staticmethod
    def _enum(d):
        return [(d.key, f.tag, code, text) for f in d.by_tag.values() for code, text in f.enums.items()]

    @staticmethod
    def _message(d):
        return [(d.key, m.msg_type, m.name, m.category) for m in d.messages]

    @staticmethod
    def _order(d):
        return [(d.key, m.msg_type, tag, i, required) for m in d.messages for i, (tag, required) in enumerate(d.order(m))]

    @staticmethod
    def _group(d):
        def walk(m, groups, parent):
            for g in groups.values():
                for i, tag in enumerate(g.members):
                    yield d.key, m.msg_type, g.count_tag, parent, g.name, g.delimiter, tag, i, tag in g.required
                yield from walk(m, g.nested, g.count_tag)

        return [r for m in d.messages for r in walk(m, d.groups(m), None)]

    @staticmethod
    def _tree(d):
        roots = [(m.name, d.body(m)) for m in d.messages] + [*d.components.items(), ("Header", d.header), ("Trailer", d.trailer)]
        return [(d.key, *r[:1], list(r[1]), *r[2:]) for name, entries in roots for r in d.tree(name, entries)]


SCHEMAS = {
    "field": "dict_key string, tag bigint, name string, type string, has_enum boolean",
    "enum": "dict_key string, tag bigint, code string, description string",
    "message": "dict_key string, msg_type string, name string, category string",
    "order": "dict_key string, msg_type string, tag bigint, ord int, required boolean",
    "group": "dict_key string, msg_type string, count_tag bigint, parent_tag bigint, name string, delimiter bigint, tag bigint, member int, required boolean",
    "tree": "dict_key string, root string, path array<int>, depth int, kind string, name string, tag bigint, required boolean",
}


def buckets(spark: SparkSession) -> DataFrame:
    """(msg_type, bucket, bucket_order) of all message types with a bucket."""
    rows = [(t, name, i) for i, (name, types) in enumerate(builtin.BUCKETS.items()) for t in types.split()]
    return spark.createDataFrame(rows, "msg_type string, bucket string, bucket_order int")


def sensitive_tags(spark: SparkSession, registry: Registry) -> DataFrame:
    """(tag, name) of the identifiers in any dictionary; of several names, that of the first dictionary."""
    found: dict[int, str] = {}
    for d in registry.known():
        for f in sorted(d.by_tag.values(), key=lambda f: f.tag):
            if re.search(builtin.SENSITIVE, f.name):
                found.setdefault(f.tag, f.name)
    return spark.createDataFrame(sorted(found.items()), "tag bigint, name string")
