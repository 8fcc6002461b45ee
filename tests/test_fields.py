import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagstream.functions import fields as fx
from tagstream.functions import sql as sql_functions
from tagstream.operators import extract, redact
from tagstream.sources.dictionary import Registry

S = "\x01"


def message(body, begin="FIX.4.4"):
    """A sealed message of `|`-separated fields."""
    body = body.replace("|", S) + S
    head = f"8={begin}{S}9={len(body.encode())}{S}{body}"
    return f"{head}10={sum(head.encode()) % 256:03d}{S}"


def frame(spark, *raws):
    return extract.with_fields(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "seq bigint, raw string"))


def lines(spark, *texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts, 1)], "source string, line_no bigint, line string")


def test_extraction(spark):
    a, b = message("35=D|11=x"), message("35=8|37=y")
    df = lines(spark, f"pre {a} mid {b} post", "nothing 8=FIX", None, "8=FIX\n10=123" + S, a + "\r" + b)
    got = [(r.line_no, r.msg_idx, r.raw) for r in extract.extract_messages(df).orderBy("line_no", "msg_idx").collect()]
    assert got == [(1, 0, a), (1, 1, b), (5, 0, a), (5, 1, b)]
    assert [r.line_no for r in extract.lines_without_messages(df).collect()] == [2, 4]


def test_a_tag_that_ends_in_ten(spark):
    raw = f"8=FIX.4.4{S}110=100{S}10=123{S}"
    df = lines(spark, raw)
    assert extract.extract_messages(df).first().raw == f"8=FIX.4.4{S}110=100{S}"
    assert extract.extract_messages(df, anchored=True).first().raw == raw


def test_tokenizer_drops_what_is_no_field(spark):
    raw = S.join(["8=FIX.4.4", "", "noequals", "=v", "x=1", "-5=a", "+7=b", "4294967296=c", "4294967295=d", "35=", "58=a=b"]) + S
    r = frame(spark, raw, "no separator", "").orderBy("seq").collect()
    assert [(f.pos, f.tag, f.value) for f in r[0].fields] == [(1, 8, "FIX.4.4"), (7, 7, "b"), (9, 4294967295, "d"), (10, 35, ""), (11, 58, "a=b")]
    assert r[1].fields == [] and r[2].fields == []


def test_first_and_last(spark):
    r = frame(spark, f"8=F{S}58=a{S}58=b{S}").select(fx.first_value(F.col("fields"), 58).alias("a"), fx.last_value(F.col("fields"), 58).alias("b"), fx.raw_value(F.col("raw"), 58).alias("c"), fx.raw_value(F.col("raw"), 59).alias("d"), fx.last_value(F.col("fields"), 1).alias("e")).first()
    assert tuple(r) == ("a", "b", "a", None, None)


@pytest.mark.parametrize("body", ["35=D|11=x", "35=D|58=Zürich – €", "35=0|58="])
def test_checksum_and_length(spark, body):
    raw = message(body)
    bad = raw[:-4] + "000" + S if not raw.endswith(f"000{S}") else raw[:-4] + "001" + S
    df = frame(spark, raw, bad, raw.replace("9=", "9=0", 1), raw.replace("9=", "9=x", 1), f"8=FIX.4.4{S}35=D{S}")
    got = df.orderBy("seq").select(fx.checksum_error(F.col("raw"), F.col("fields")).alias("c"), fx.body_length_error(F.col("raw"), F.col("fields")).alias("l")).collect()
    assert got[0].c is None and got[0].l is None
    assert got[1].c.startswith("checksum mismatch")
    assert got[2].l is None  # 005 is 5
    assert got[3].l.startswith("body length not a number")
    assert got[4].c == "checksum missing" and got[4].l == "body length missing"


def test_empty_body_length(spark):
    raw = f"8=FIX.4.4{S}9=0{S}10=000{S}"
    assert frame(spark, raw).select(fx.body_length(F.col("raw"))).first()[0] == 0


GOOD = {
    "INT": ["1", "-7", "+3", "007"],
    "PRICE": ["1", "1.", ".5", "-2.25", "1e5", "inf", "NaN"],
    "BOOLEAN": ["Y", "N"],
    "CHAR": ["a", "é"],
    "UTCTIMESTAMP": ["20240102-03:04:05", "20240102-03:04:05.123"],
    "UTCDATEONLY": ["20240229"],
    "UTCTIMEONLY": ["23:59", "00:00:00", "12:30:01.250"],
    "MONTHYEAR": ["202401", "20240115", "202401-5", "202401-15", "202401w3", "202401-w5"],
    "STRING": ["", "x"],
    "LOCALMKTDATE": ["whatever"],
}
BAD = {
    "INT": ["", " 35", "1.5", "a", "99999999999999999999"],
    "QTY": ["", "1d", "abc", "1f", ".", "1e"],
    "BOOLEAN": ["y", "", "YES"],
    "CHAR": ["", "ab"],
    "UTCTIMESTAMP": ["20240230-00:00:00", "2024-01-02", "20240102-25:00:00", ""],
    "UTCDATEONLY": ["20230229", "2024010"],
    "UTCTIMEONLY": ["24:00", "1:00", "12:30:61"],
    "MONTHYEAR": ["2024", "202401w6", "202401-"],
}


def test_types(spark):
    rows = [(k, v, True) for k, vs in GOOD.items() for v in vs] + [(k, v, False) for k, vs in BAD.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v string, want boolean").withColumn("got", fx.type_allows(F.col("k"), F.col("v")))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []
    assert spark.createDataFrame([("qty", "5")], "k string, v string").select(fx.type_allows(F.col("k"), F.col("v"))).first()[0]


def test_business_days(spark):
    rows = [("20240105", "20240105", 0), ("20240105", "20240108", 1), ("20240105", "20240109", 2), ("20240105", "20240106", 0), ("20240105", "20240104", None), ("bad", "20240104", None), ("20240105", "20240115", 6)]
    df = spark.createDataFrame(rows, "t string, s string, want int").withColumn("got", fx.business_days(F.col("t"), F.col("s")))
    assert [tuple(r) for r in df.collect() if r.got != r.want] == []


def test_states_and_labels(spark):
    df = spark.createDataFrame([("2", None, None, None), (None, "F", None, None), (None, None, "3", None), (None, None, None, "0"), (None, None, None, None), ("?", "0", None, None)], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(fx.order_state(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == ["Filled", "Trade", "Rejected", "Filled", "Unknown", "New"]
    r = spark.range(1).select(fx.side_label(F.lit("5")), fx.side_label(F.lit("x")), fx.enum_label(F.lit("GOOD_TILL"), F.lit("1")), fx.group_title(F.lit("NoOrders")), fx.group_title(F.lit("Note")), fx.ascii_only(F.lit("aé"))).first()
    assert tuple(r) == ("SellShort", "Side?", "Good_till (1)", "Orders", "Note", "a?")


def test_delimiters():
    assert [fx.parse_delimiter(x) for x in ("soh", "\\x7c", "0x02", ";")] == [S, "|", "\x02", ";"]
    with pytest.raises(ValueError):
        fx.parse_delimiter("ab")


def test_sequence_over_sources(spark):
    df = spark.createDataFrame([(s, n, i) for s in ("b", "a") for n in (70000, 1, 3) for i in (1, 0)], "source string, line_no bigint, msg_idx int")
    got = [(r.source, r.line_no, r.msg_idx) for r in extract.number_messages(df).orderBy("seq").collect()]
    assert got == sorted(got) and [r.seq for r in extract.number_messages(df).orderBy("seq").collect()] == list(range(1, 13))


def test_sql_functions(spark):
    sql_functions.register(spark)
    frame(spark, message("35=D|453=1|448=a|447=D|58=x")).createOrReplaceTempView("m")
    r = spark.sql("SELECT fix_tag(raw, 35) a, fix_tag(raw, 99) b, size(fix_extract(raw)) c, fix_checksum(raw) = right(rtrim(chr(1), raw), 3) d, fix_state('2', NULL, NULL, NULL) e FROM m").first()
    assert tuple(r) == ("D", None, 1, True, "Filled")
    assert spark.sql("SELECT g.tag, g.path FROM m, LATERAL fix_groups(raw, 'FIX44') g WHERE g.path <> ''").collect() == [(448, "453[1]"), (447, "453[1]")]


@settings(max_examples=15, deadline=None)
@given(values=st.lists(st.text(st.characters(blacklist_characters="\x01\n\r", blacklist_categories=("Cs",)), min_size=1, max_size=8), min_size=1, max_size=5))
def test_redacted_messages_are_valid(spark, values):
    raws = [message("35=D|" + "|".join(["49=" + values[0].replace("|", "!"), "1=" + v.replace("|", "!")])) for v in values]
    df = extract.with_fields(spark.createDataFrame([("s", i, 0, r) for i, r in enumerate(raws)], "source string, line_no bigint, msg_idx int, raw string"))
    out = redact.redact_messages(df, Registry()).select("redacted", fx.checksum(F.col("redacted")).alias("c"), fx.body_length(F.col("redacted")).alias("l")).collect()
    for r in out:
        found = dict(f.split("=", 1) for f in r.redacted.split(S) if f)
        assert found["10"] == r.c and int(found["9"]) == r.l and found["49"] == "SenderCompID0001" and found["1"].startswith("Account000")
