"""Orders, their replay after every prefix against a plain model, and the streaming equals of batch queries."""

import random

import pytest
from pyspark.sql import functions as F

from tagstream.functions import fields as fx
from tagstream.operators import enrich, extract, lifecycle
from tagstream.sources.dictionary import Registry
from tagstream.streaming import follow
from tests.test_fields import message


def events_of(spark, *raws):
    registry = Registry()
    df = extract.with_fields(spark.createDataFrame([(i, "s", i, 0, r) for i, r in enumerate(raws, 1)], "seq bigint, source string, line_no bigint, msg_idx int, raw string"))
    return lifecycle.events(enrich.with_message_type(enrich.resolve(df, registry), registry))


def report(kind="8", **tags):
    names = {"id": 37, "cl": 11, "orig": 41, "status": 39, "exec": 150, "ack": 1036, "t": 60, "cum": 14, "leaves": 151, "px": 31, "qty": 38, "text": 58, "d75": 75, "d64": 64}
    return message(f"35={kind}|49=A|56=B" + "".join(f"|{names[k]}={v}" for k, v in tags.items()))


class Model:
    """Identity, order of events and paths, one message at a time."""

    def __init__(self):
        self.owner, self.events = {}, {}

    def add(self, seq, tags):
        ids = [tags.get(t) for t in (37, 11, 41)]
        if tags[35] in "012345An" or not (ids[0] or ids[1] or ids[2] in self.owner):
            return
        key = next((self.owner[x] for x in ids if x and x in self.owner), None) or ids[0] or ids[1]
        for x in ids:
            if x:
                self.owner.setdefault(x, key)
        state = fx.ORDER_STATUS.get(tags.get(39)) or fx.EXEC_TYPE.get(tags.get(150)) or "Unknown"
        self.events.setdefault(key, []).append((tags.get(60) is None, tags.get(60) or "", seq, state))

    def paths(self):
        out = {}
        for key, events in self.events.items():
            states = []
            for *_, s in sorted(events):
                if not states or states[-1] != s:
                    states.append(s)
            out[key] = " -> ".join(states[1:] if len(states) > 1 and states[0] == "Unknown" else states)
        return out


@pytest.mark.parametrize("seed", range(2))
def test_replay_of_prefixes(spark, seed):
    rnd = random.Random(seed)
    raws, tags = [], []
    for i in range(60):
        chosen = {"cl": f"c{rnd.randrange(8)}"}
        if rnd.random() < 0.5:
            chosen["id"] = f"o{rnd.randrange(5)}"
        if rnd.random() < 0.4:
            chosen["orig"] = f"c{rnd.randrange(8)}"
        if rnd.random() < 0.15:
            chosen.pop("cl")
        if rnd.random() < 0.8:
            chosen["status"] = rnd.choice("0124")
        if rnd.random() < 0.9:
            chosen["t"] = f"20240102-10:00:{rnd.randrange(60):02d}.{i:03d}"
        kind = rnd.choice("D88G0")
        raws.append(report(kind, **chosen))
        tags.append({35: kind} | {{"id": 37, "cl": 11, "orig": 41, "status": 39, "t": 60}[k]: v for k, v in chosen.items()})
    for n in (7, 25, 60):
        model = Model()
        for i in range(n):
            model.add(i + 1, tags[i])
        keyed = lifecycle.resolve_identity(events_of(spark, *raws[:n]))
        got = {r.order_key: r.flow for r in lifecycle.state_paths(keyed).collect()}
        assert got == model.paths()


def test_late_and_repeated_events(spark):
    a = report(id="1", status="0", t="20240102-10:00:00")
    b = report(id="1", status="1", t="20240102-10:00:01", cum="5")
    c = report(id="1", status="2", t="20240102-10:00:02")
    keyed = lifecycle.single_id(events_of(spark, c, a, b, b, a, report("D", id="1")))
    assert lifecycle.ordered_events(keyed).count() == 4
    r = lifecycle.state_paths(keyed).first()
    assert r.states == ["New", "Partially Filled", "Filled", "Unknown"] and r.flow == "New -> Partially Filled -> Filled -> Unknown"
    rec = lifecycle.order_records(lifecycle.single_id(events_of(spark, c, a, b))).first()
    assert rec.is_terminal and rec.flow == "New -> Partially Filled -> Filled"


def test_attributes_first_and_last(spark):
    raws = [report("D", cl="a", qty="10", t="20240105-10:00:00"), report(id="o", cl="b", orig="a", status="0", cum="1", d75="20240108"), report(id="o", cl="c", status="1", cum="2", t="20240106-09:00:00", d64="20240109"), report("BN", id="o", px="1.25", qty="99", ack="1")]
    keyed = lifecycle.resolve_identity(events_of(spark, *raws))
    r = lifecycle.order_records(keyed).first()
    assert (r.order_key, r.order_id, r.cl_ord_id, r.orig_cl_ord_id, r.cum_qty, r.order_qty) == ("a", "o", "a", "a", "2", "99")
    assert (r.trade, r.settle, r.spot, r.exec_amount, r.has_notice, r.is_terminal) == ("20240106", "20240109", "1.25", "99", True, True)
    s = lifecycle.summary_rows(lifecycle.order_records(keyed)).first()
    assert (s.display_id, s.tenor, s.spot) == ("o", "SPOT", "1.25")
    assert lifecycle.order_totals(lifecycle.order_records(keyed)).first().n_terminal == 1


def test_no_merging_of_known_orders(spark):
    raws = [report(id="x", cl="1", status="0"), report(id="y", cl="2", status="0"), report(cl="2", orig="1", status="5"), report(orig="1", status="4"), report(orig="zz", status="4")]
    keyed = lifecycle.resolve_identity(events_of(spark, *raws))
    assert {r.seq: r.order_key for r in keyed.collect()} == {1: "x", 2: "y", 3: "y", 4: "x"}
    glued = [report(id="NONE", cl="1"), report(id="NONE", cl="2")]
    assert len({r.order_key for r in lifecycle.resolve_identity(events_of(spark, *glued)).collect()}) == 1
    assert len({r.order_key for r in lifecycle.resolve_identity(events_of(spark, *glued), ignore_ids=("NONE",)).collect()}) == 2


def test_timeline_and_sections(spark):
    raws = [report("D", cl="a", t="20240102-10:00:00"), report(id="o", cl="b", orig="a", status="0", text="hi", t="20240102-10:00:01"), report(cl="q", status="8")]
    events = events_of(spark, *raws).withColumn("reason", F.when(F.col("seq") == 2, "bad"))
    keyed = lifecycle.resolve_identity(events)
    t = lifecycle.timeline(keyed).where("order_key = 'a'").orderBy("place").collect()
    assert [(r.cell, r.text) for r in t] == [("D [a]", ""), ("8 [b,a]", "hi | Invalid: bad")]
    got = {(r.order_key, r.msg_type): r.n for r in lifecycle.section_counts(lifecycle.order_attributes(keyed), keyed).collect()}
    assert got == {("a", "D"): 1, ("a", "8"): 1, ("q", "D"): 1, ("q", "8"): 2}
    order = [r.order_key for r in lifecycle.report_order(lifecycle.order_records(keyed)).collect()]
    assert order == ["q", "a"]


def test_report_with_descriptions(spark):
    registry = Registry()
    raws = [
        message("35=D|49=A|56=B|11=c|40=2|59=1|54=5|60=20240102-10:00:00"),
        message("35=8|49=B|56=A|37=o|11=c|40=Z|193=20240104|64=20240109|150=F|39=1|32=5|31=1.5|14=5|151=7|6=1.5|60=20240102-10:00:01"),
        message("35=ZZ|49=B|56=A|37=o|64=20240110|39=2|1036=1|150=z|60=20240102-10:00:02"),
        message("35=D|49=A|56=B|11=open|60=20240102-10:00:00"),
    ]
    df = extract.with_fields(spark.createDataFrame([(i, "s", i, 0, r) for i, r in enumerate([*raws, raws[1]], 1)], "seq bigint, source string, line_no bigint, msg_idx int, raw string"))
    m = enrich.with_message_type(enrich.resolve(df, registry), registry)
    keyed = lifecycle.resolve_identity(lifecycle.events(m, registry))
    records = lifecycle.order_records(keyed)
    s = {r.display_id: r for r in lifecycle.summary_rows(records).collect()}
    assert (s["o"].side, s["o"].ord_type, s["o"].time_in_force, s["o"].trade_date) == ("SELLSHORT", "LIMIT", "GOOD_TILL_CANCEL", "20240102")
    assert (s["o"].settle_name, s["o"].settle, s["o"].days, s["o"].tenor) == ("SettlDate2", "20240104", 2, "SPOT")
    assert (s["open"].side, s["open"].settle_name, s["open"].settle, s["open"].is_terminal) == (None, "ValueDate", None, False)
    t = lifecycle.timeline(keyed).where("order_key = 'c'").orderBy("place").collect()
    assert [r.cell for r in t] == ["NEW_ORDER_SINGLE [c]", "EXECUTION_REPORT [c]", "ZZ"]
    assert [(r.exec_type, r.ord_status, r.exec_ack, r.cum_leaves, r["last"], r.avg_px) for r in t] == [("-", "-", "-", "-/-", "-@-", "-"), ("Trade", "Partially Filled", "-", "5/7", "5@1.5", "1.5"), ("z", "Filled", "Accepted", "-/-", "-@-", "-")]
    shown = lifecycle.raw_messages(keyed, records, m, "|").orderBy("order_key", "place").collect()
    assert [(r.order_key, r.seq, r.text) for r in shown] == [("c", i, raws[i - 1].replace(fx.SOH, "|")) for i in (1, 2, 3)]


def test_nothing_to_do(spark):
    none = events_of(spark, message("35=0"))
    assert lifecycle.resolve_identity(none).count() == 0
    assert lifecycle.order_totals(lifecycle.order_records(lifecycle.single_id(none))).first().n_total == 0


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    raws = [report(rnd.choice("D8"), id=f"o{rnd.randrange(6)}", cl=f"c{i}", status=rnd.choice("0124"), t=f"20240102-10:{rnd.randrange(60):02d}:00") for i in range(80)]
    raws = [r.replace("35=D", "35=D").replace("49=A", f"34={i}\x0149=A") for i, r in enumerate(raws)]
    for n in range(3):
        (tmp_path / f"{n}.log").write_text("\n".join(f"log {r} x" for r in raws[n::3]) + "\n", newline="")
    counts = {r.msg_type: r.n for r in follow.run_counts(spark, str(tmp_path)).collect()}
    assert sum(counts.values()) == 80
    got = {r.order_key: (r.n_messages, r.flow, r.is_terminal) for r in follow.run_orders(spark, str(tmp_path)).collect()}
    df = events_of(spark, *raws).withColumn("seq", F.col("seq") - 1)
    want = {r.order_key: (r.n_messages, r.flow, r.is_terminal) for r in lifecycle.order_records(lifecycle.single_id(df)).collect()}
    assert got == want
