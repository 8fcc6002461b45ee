"""Rendering, browsing, and keyed state over streams of several batches."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagstream.operators import reassembly, render, validate
from tagstream.sources.dictionary import Registry
from tagstream.streaming import follow, state
from tests.test_fields import message
from tests.test_rules import ORDER, prepared


def test_groups_have_headings(spark):
    head, tail = "35=D|49=A|56=B|34=1|52=20240102-10:00:00|11=c|", "|21=1|55=S|54=1|60=20240102-10:00:00|38=100|40=1"
    m, registry = prepared(spark, message(head + "453=2|448=a|802=2|523=x|523=y|448=b" + tail))
    lines = [(r.kind, r.text) for r in render.rendered_lines(m, registry).orderBy("ord").collect()]
    around = [x for x in lines if "Party" in x[1]]
    assert [k for k, _ in around] == ["field", "entry", "field", "field", "entry", "field", "entry", "field", "entry", "field"]
    assert around[1][1] == "  PartyIDs 1" and around[4][1] == "      PartySubIDs 1" and around[6][1] == "      PartySubIDs 2" and around[8][1] == "  PartyIDs 2"
    assert around[7][1].startswith(" " * 8)


def test_faults_beside_their_fields(spark):
    m, registry = prepared(spark, message(ORDER.replace("|54=1", "").replace("40=1", "40=?")))
    found = validate.violations(m, registry)
    lines = {r.kind: r.text for r in render.rendered_lines(m, registry, found).where("kind = 'missing' or text like '%(OrdType)%'").collect()}
    assert lines == {"field": "  40 (OrdType): ?  tag 40: value ? is not listed", "missing": "  54  required tag 54 missing"}


def test_canonical_order(spark):
    m, registry = prepared(spark, message("35=D|40=1|11=c|52=x|34=1|99999=z|89=s|93=1|49=A"))
    tags = [f.tag for f in render.canonical_fields(m, registry).first().canonical]
    assert tags == [8, 9, 35, 49, 34, 52, 11, 40, 99999, 93, 89, 10]


def test_browsing(spark):
    registry = Registry()
    tree = render.message_tree(spark, registry, "4.4".replace(".", "").join(["FIX", ""]), "D").collect()
    kinds = {r.tag: r for r in tree if r.tag}
    assert kinds[35].enums == ["D=NEW_ORDER_SINGLE"] and "1=BUY" in kinds[54].enums
    assert render.message_tree(spark, registry, "FIX44", "0", envelope=False).first().name == "TestReqID"
    with pytest.raises(ValueError):
        render.message_tree(spark, registry, "FIX44", "nothing")
    rows = {r.dict_key: r for r in render.dictionary_overview(spark, registry, "FIX42").collect()}
    assert set(rows) == set(registry.keys()) and rows["FIX42"].selected and rows["FIXT11"].n_messages == 7


def test_flows_over_batches(spark, tmp_path):
    raws = [message(f"35=D|11=c{i}|58={'x' * (i * 9)}") for i in range(6)]
    rows = []
    for i, raw in enumerate(raws):
        data = raw.encode() * 2
        for n, at in enumerate(range(0, len(data), 25)):
            rows.append((n + 1, 0, f"s{i}", at, False, bytearray(data[at : at + 25])))
        rows.append((0, 0, f"s{i}", 0, True, bytearray()))
    df = spark.createDataFrame(rows, "packet_index bigint, ts_us bigint, src string, tcp_seq bigint, syn boolean, payload binary").selectExpr("'f' source", "packet_index", "ts_us", "src", "'d' dst", "1 sport", "2 dport", "tcp_seq", "syn", "false fin", "false rst", "payload", "CAST(NULL AS STRING) loss")
    for n, (low, high) in enumerate(((0, 2), (2, 4), (4, 99))):
        df.where(f"packet_index >= {low} and packet_index < {high}").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    out = f"{tmp_path}/out"
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    follow.drain(state.flow_messages(stream), "append", lambda q: q.format("parquet").option("path", out))
    got = sorted(r.raw for r in spark.read.schema(state.FLOWS).parquet(out).collect())
    assert got == sorted(r.raw for r in reassembly.reassemble(df).where("raw is not null").collect()) == sorted(raws * 2)


def test_flow_lives():
    f, key = state.FlowMessages(idle_us=10), ("s", "a", "b", 1, 2)
    raw = message("35=0").encode()
    row = lambda i, ts, seq, data=b"", syn=False, fin=False: {"packet_index": i, "ts_us": ts, "tcp_seq": seq, "syn": syn, "fin": fin, "rst": False, "payload": data}
    out = [x for r in (row(0, 0, 5, syn=True), row(1, 1, 5, raw[:9]), row(2, 50, 14, raw[9:]), row(3, 51, 900, syn=True), row(4, 52, 900, raw, fin=True), row(5, 53, 7, raw)) for x in f(key, r)]
    assert [(x[5], x[7], x[8]) for x in out] == [(2, None, 1), (4, raw.decode(), 0), (5, raw.decode(), 0)]


def test_aliases_and_sessions():
    a = state.Aliases()
    assert [x for v in "xyx" for x in a(("s", 49), {"value": v, "name": "N"})] == [("s", 49, "x", "N0001"), ("s", 49, "y", "N0002")]
    s = state.SessionDefault()
    rows = [(1, None), (2, "FIX50"), (3, None), (4, "FIX50SP2"), (5, None)]
    assert [x[2] for n, v in rows for x in s(("k",), {"seq": n, "raw": "", "named": v})] == [None, None, "FIX50", "FIX50", "FIX50SP2"]
    assert F is not None


def aliases_of(spark, tmp_path, name, rows, apply, parts=2):
    """What a stream of `parts` files makes of rows (source, tag, name, value, seq), and the states it keeps."""
    df = spark.createDataFrame(rows, "source string, tag bigint, name string, value string, seq bigint")
    for n in range(parts):
        df.where(f"seq % {parts} = {n}").coalesce(1).write.parquet(f"{tmp_path}/{name}/in/{n}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in/*")
    out = f"{tmp_path}/{name}/out"
    q = apply(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}/check").trigger(availableNow=True).format("parquet").option("path", out).start()
    q.awaitTermination()
    assert q.exception() is None
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return sorted((r.source, r.value, r.alias) for r in spark.read.parquet(out).collect()), max(states)


def test_many_keys_are_few_states(spark, tmp_path):
    rows = [(f"s{k}" if k else None, 1, "N", f"v{(k + n) % 3}", 400 * n + (n + k) % 2) for k in range(200) for n in range(4)]
    seen, expected = {}, []
    for source, _, name, value, _ in sorted(rows, key=lambda r: (r[4] % 2, r[4])):  # a file after the other
        own = seen.setdefault(source, {})
        if value not in own:
            own[value] = len(own) + 1
            expected.append((source, value, f"{name}{own[value]:04d}"))
    got, states = aliases_of(spark, tmp_path, "many", [r for r in rows if r[0]], lambda s: state.process(s, ["source", "tag"], "seq", state.Aliases, "source string, tag bigint, value string, alias string", buckets=8))
    assert got == sorted(x for x in expected if x[0]) and states <= 8


def test_silent_keys_of_a_bucket_end(spark):
    """The function that Spark would call, on a state of our own."""

    class Frame:
        schema = spark.createDataFrame([], "source string, tag bigint, name string, value string, seq bigint").schema

        def __getattr__(self, name):
            return lambda f, *rest: f if name == "applyInPandasWithState" else self

    class State:
        get, hasTimedOut, now, wait = None, False, 0, None
        exists = property(lambda self: self.get is not None)
        getCurrentProcessingTimeMs = lambda self: self.now
        update = lambda self, x: setattr(self, "get", x)
        remove = lambda self: setattr(self, "get", None)
        setTimeoutDuration = lambda self, ms: setattr(self, "wait", ms)

    f, s = state.process(Frame(), ["source", "tag"], "seq", state.Aliases, "source string, tag bigint, value string, alias string", 100), State()
    call = lambda now, *rows: setattr(s, "now", now) or [r for d in f((0,), iter([pd.DataFrame(rows, columns=Frame.schema.names)] if rows else []), s) for r in d["alias"]]
    assert call(0, ("a", 1, "N", "x", 1), ("b", 1, "N", "x", 2), ("a", 1, "N", "y", 0)) == ["N0001", "N0002", "N0001"] and s.wait == 100
    assert call(60, ("a", 1, "N", "z", 3)) == ["N0003"] and s.wait == 40
    s.hasTimedOut = True
    assert call(100) == [] and s.exists and s.wait == 60  # b ends, a stays
    s.hasTimedOut = False
    assert call(110, ("a", 1, "N", "x", 5), ("b", 1, "N", "y", 4)) == ["N0001"]
    s.hasTimedOut = True
    assert call(500) == [] and not s.exists


def test_repeats_of_a_value_are_dealt_once(spark, tmp_path, monkeypatch):
    rows = [("s", 49, "N", f"v{n * 7919 % 400}", n) for n in range(20_000)]
    got, _ = aliases_of(spark, tmp_path, "hot", rows, state.aliases, 1)
    assert got == sorted(("s", f"v{n * 7919 % 400}", f"N{n + 1:04d}") for n in range(400))
    batches = [spark.createDataFrame(rows[a : a + 5000][::-1], "source string, tag bigint, name string, value string, seq bigint").toArrow().to_batches() for a in range(0, 20_000, 5000)]
    found = [b for b in state._first_seen(x for y in batches for x in y)]
    assert [b.num_rows for b in found] == [400] and sorted(found[0].column("seq").to_pylist()) == list(range(400))
    monkeypatch.setattr(state, "DISTINCT", 100)
    parts = [r for b in state._first_seen(x for y in batches for x in y) for r in b.to_pylist()]
    assert len(parts) < 20_000 / 2 and {v: min(r["seq"] for r in parts if r["value"] == v) for v in {r["value"] for r in parts}} == {f"v{n * 7919 % 400}": n for n in range(400)}
