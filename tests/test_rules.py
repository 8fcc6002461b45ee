"""Dictionaries, resolution, validation, groups and redaction on small messages."""

import os

import pytest
from pyspark.sql import functions as F

from tagstream.operators import enrich, extract, groups, redact, validate
from tagstream.plans import builtin, catalog
from tagstream.sources import dictionary, logs
from tests.test_fields import S, message

ORDER = "35=D|49=A|56=B|34=1|52=20240102-10:00:00|11=c|1=acc|21=1|55=S|54=1|60=20240102-10:00:00|38=100|40=1"


def prepared(spark, *raws, registry=None, override=None):
    registry = registry or dictionary.Registry()
    df = extract.with_fields(spark.createDataFrame([(i, "s", i, 0, r) for i, r in enumerate(raws)], "seq bigint, source string, line_no bigint, msg_idx int, raw string"))
    return enrich.with_message_type(enrich.resolve(df, registry, override), registry), registry


def rules(spark, *raws, **options):
    m, registry = prepared(spark, *raws, **options)
    found = validate.violations(m, registry).collect()
    return [sorted((v.rule, v.tag) for v in found if v.seq == i) for i in range(len(raws))]


def test_clean_and_faulty_messages(spark):
    got = rules(
        spark,
        message(ORDER),
        message(ORDER.replace("35=D|", "")),
        message(ORDER.replace("35=D", "35=ZZ")),
        message(ORDER.replace("|54=1", "")),
        message(ORDER + "|77777=1"),
        message(ORDER.replace("40=1", "40=?").replace("38=100", "38=x")),
        message(ORDER.replace("|38=100|40=1", "|40=1|38=100")),
        message(ORDER + "|40=1"),
        message(ORDER).replace("10=", "10=9")[:-1],
    )
    assert got[0] == []
    assert ("msg_type", 35) in got[1]
    assert got[2] == [("enum", 35), ("msg_type", 35)]
    assert got[3] == [("required", 54)]
    assert got[4] == [("unknown_tag", 77777)]
    assert got[5] == [("enum", 40), ("type", 38)]
    assert got[6] == [("out_of_order", 38)]
    assert got[7] == [("duplicate_tag", 40)]
    assert ("checksum", 10) in got[8]


def test_repeating_groups(spark):
    head, tail = "35=D|49=A|56=B|34=1|52=20240102-10:00:00|11=c|", "|21=1|55=S|54=1|60=20240102-10:00:00|38=100|40=1"
    party = "448=a|447=D|452=1|802=1|523=x|803=1"
    got = rules(
        spark,
        message(head + f"453=2|{party}|448=b|447=D|452=3" + tail),
        message(head + f"453=3|{party}|448=b" + tail),
        message(head + "453=x|448=a" + tail),
        message(head + "453=1|447=D|448=a" + tail),
        message(head + "453=1|448=a|452=1|447=D" + tail),
        message(head + "453=1|448=a|447=D|447=D" + tail),
        message(head + "447=D" + tail),
    )
    assert got[0] == []
    assert got[1] == [("group_count_mismatch", 453)]
    assert ("group_bad_count", 453) in got[2] and ("group_member_outside", 448) in got[2]
    assert got[3] == [("group_before_delimiter", 447)]
    assert got[4] == [("group_out_of_order", 447)]
    assert got[5] == [("duplicate_tag", 447)]
    assert got[6] == [("group_member_outside", 447)]


def walk(mode, *pairs):
    d = dictionary.Registry().resolve("FIX44")
    m = next(m for m in d.messages if m.msg_type == "D")
    return [(s.index, groups.path_text(s.path), s.rule) for s in groups.Walker(list(pairs), d.groups(m), {t for t, _ in d.order(m)}, mode).walk()]


def test_modes_of_the_walker():
    entry = [(453, "2"), (447, "D"), (448, "a"), (447, "E"), (452, "1"), (58, "t")]
    assert [s[1] for s in walk(groups.RENDER, *entry)] == ["", "453[1]", "453[2]", "453[2]", "453[2]", ""]
    assert [s[1] for s in walk(groups.DUPLICATES, *entry)] == ["", "453[1]", "453[2]", "453[2]", "453[2]", ""]
    assert (1, "", "group_before_delimiter") in walk(groups.VALIDATE, *entry)
    assert walk(groups.VALIDATE, (453, "0"), (58, "t")) == [(0, "", None), (1, "", None)]
    assert groups.declared_count("+2") == 2 and groups.declared_count("") is None and groups.declared_count("²") is None


def test_flat_groups_without_python(spark):
    m, _ = prepared(spark, message("35=J|73=2|11=a|38=1|11=b|37=x|54=1"), message("35=J|73=1|11=a|11=b"), message("35=J|54=1"), message("35=J|73=x|11=a"))
    got = groups.explode_flat_group(m, 73, 11, [11, 37, 38], "seq").collect()
    assert [(r.seq, r.entry, [f.tag for f in r.entry_fields]) for r in got] == [(0, 1, [11, 38]), (0, 2, [11, 37]), (1, 1, [11])]


def test_dictionary_from_xml():
    r = dictionary.Registry()
    key = r.add_xml(catalog.CUSTOM_XML)
    d = r.resolve(key)
    assert key == "FIX49" and [m.name for m in d.messages] == ["Zed"]
    g = d.groups(d.messages[0])[200]
    assert (g.delimiter, g.members, g.required) == (201, [201, 202], [202])
    assert [t for t, _ in d.order(d.messages[0])] == [8, 9, 35, 200, 10]
    r.add_xml(catalog.CUSTOM_XML)
    r.add_xml(catalog.CUSTOM_XML.replace('minor="9"', 'minor="4"'))
    assert len(r.warnings) == 2
    with pytest.raises(ValueError):
        dictionary.from_xml("<fix><fields/></fix>")


def test_components_that_contain_themselves():
    d = dictionary.compact("X", "1 A INT\n2 B INT", "C: A @D\nD: B @C", "m app M: @C", "", "")
    assert [t for t, _ in d.order(d.messages[0])] == [1, 2] and d.warnings
    assert [(r[4], r[2]) for r in d.tree("M", d.messages[0].entries)] == [("C", 1), ("A", 2), ("D", 2), ("B", 3), ("C", 3)]


def test_keys():
    assert [dictionary.normal_key(k) for k in ("4.4", "fix.4.2", "FIX50SP2", "FIXT.1.1")] == ["FIX44", "FIX42", "FIX50SP2", "FIXT11"]
    assert dictionary.key_of("FIX", "5", "0", "0") == "FIX50" and dictionary.key_of("FIX", "5", "0", "2") == "FIX50SP2"
    assert sum(len(v.split()) for v in builtin.BUCKETS.values()) == 164
    r = dictionary.Registry()
    assert r.resolve("FIX27").key == "FIX40" and r.resolve("NONE").key == "FIX44"
    assert r.browsable("FIX50SP2").header and not r.dictionaries["FIX50SP2"].header


def test_session_defaults(spark):
    logon = lambda a, b, v: message(f"35=A|49={a}|56={b}|1137={v}", "FIXT.1.1")
    app = lambda a, b, extra="": message(f"35=D|49={a}|56={b}{extra}", "FIXT.1.1")
    m, _ = prepared(spark, app("A", "B"), logon("A", "B", "9"), app("B", "A"), app("A", "C"), logon("B", "A", "77"), app("A", "B"), app("A", "B", "|1128=6"), message("35=D").replace("8=FIX.4.4" + S, "", 1))
    assert [r.dict_key for r in m.orderBy("seq").collect()] == ["FIX50", "FIX50SP2", "FIX50SP2", "FIX50", "FIX50SP2", "FIX50SP2", "FIX44", "FIX44"]


def test_override(spark):
    m, registry = prepared(spark, message(ORDER), override="FIX42")
    r = m.first()
    assert (r.dict_key, r.fallback_key, r.fallback_role) == ("FIX42", "FIX44", "DetectedOverride")
    m, registry = prepared(spark, message(ORDER), override="FIX44")
    assert m.first().fallback_key is None
    m, registry = prepared(spark, message(ORDER), override="FIX88")
    assert m.first().dict_key == "FIX44" and registry.warnings


def test_tags_only_the_override_knows(spark):
    got = rules(spark, message(ORDER + "|20=0"), override="FIX42")[0]
    assert ("not_in_detected", 20) in got


def test_counts_and_buckets(spark):
    m, _ = prepared(spark, message("35=0"), message("35=D"), message("35=D"), message("35=i"), message("35=??"), message("35=n"))
    got = [(r.bucket, r.msg_type, r.name, r.n) for r in enrich.count_report(enrich.count_messages(enrich.with_bucket(m))).collect()]
    assert got == [("Session/Admin", "0", "Heartbeat", 1), ("Session/Admin", "n", None, 1), ("Order Flow", "D", "NewOrderSingle", 2), ("Quotes & Pricing", "i", None, 1), ("Other", "??", None, 1)]


def test_redaction(spark):
    a, b = message("35=D|49=me|56=you|1=acc1"), message("35=D|49=you|56=me|1=acc1|58=x")
    lines = spark.createDataFrame([("f", 1, f"x {a} y {b}"), ("f", 2, "plain"), ("g", 1, b)], "source string, line_no bigint, line string")
    m = extract.with_fields(extract.extract_messages(lines))
    done = redact.redact_messages(m, dictionary.Registry())
    names = {(r.source, r.tag, r.value): r.alias for r in redact.aliases(m, dictionary.Registry()).collect()}
    assert names["f", 49, "me"] == "SenderCompID0001" and names["f", 49, "you"] == "SenderCompID0002" and names["g", 49, "you"] == "SenderCompID0001"
    clean = {(r.source, r.line_no): r.clean for r in redact.redact_lines(lines, done).collect()}
    assert clean["f", 2] == "plain"
    first = message("35=D|49=SenderCompID0001|56=TargetCompID0001|1=Account0001")
    second = message("35=D|49=SenderCompID0002|56=TargetCompID0002|1=Account0001|58=x")
    assert clean["f", 1] == f"x {first} y {second}"
    plain = message("35=0|112=t").replace("9=", "9=7", 1)
    m = extract.with_fields(spark.createDataFrame([("f", 1, 0, plain)], "source string, line_no bigint, msg_idx int, raw string"))
    assert redact.redact_messages(m, dictionary.Registry()).first().redacted == plain


def test_copies(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text(f"one {message('35=D|49=me|56=you')}\r\ntwo\n\nlast", newline="")
    os.chmod(path, 0o640)
    lines = logs.read_logs(spark, [str(path)])
    assert [(r.line_no, r.line) for r in lines.where("line_no > 1").orderBy("line_no").collect()] == [(2, "two"), (3, ""), (4, "last")]
    plan = redact.plan_copies([str(path)])
    assert plan == {str(path): str(tmp_path / "a.secret.log")}
    m = extract.with_fields(extract.extract_messages(lines))
    uri = lines.first().source
    redact.write_copies(redact.redact_lines(lines, redact.redact_messages(m, dictionary.Registry())), {uri: plan[str(path)]})
    text = (tmp_path / "a.secret.log").read_text()
    assert text.startswith("one 8=FIX.4.4") and "SenderCompID0001" in text and text.endswith("\ntwo\n\nlast\n")
    with pytest.raises(FileExistsError):
        redact.plan_copies([str(path)])
    with pytest.raises(ValueError):
        redact.plan_copies(["x/n", "y/n"], "z")
    assert redact.redacted_name("d/name") == "d/name.secret" and redact.redacted_name(".rc") == ".rc.secret"
    assert logs.missing_paths([str(path), "/nonexistent"]) == ["/nonexistent"]
    large = logs.read_large_logs(spark, [str(path)]).orderBy("line_no").collect()
    assert [r.line for r in large][1:] == ["two", "", "last"]


def test_reasons_in_report_order(spark):
    m, registry = prepared(spark, message(ORDER.replace("|54=1", "") + "|77777=1"))
    r = validate.reasons(validate.violations(m, registry)).first()
    assert r.reason == "unknown tag 77777 in FIX44; required tag 54 missing"
    assert validate.invalid(m, validate.violations(m, registry)).count() == 1


def test_rendering(spark):
    m, registry = prepared(spark, message("35=D|54=1|77777=q"))
    text = enrich.render_messages(m, registry).first().text.split("\n")
    assert "  54 (Side): 1 (BUY)" in text and "77777 (77777): q" in text and "  35 (MsgType): D (NEW_ORDER_SINGLE)" in text


def test_group_delimiter_through_component():
    d = dictionary.Registry().resolve("FIX44")
    m = next(m for m in d.messages if m.msg_type == "W")
    assert d.groups(m)[268].delimiter == 269
    assert (268, True) in d.order(m)
    assert F is not None
