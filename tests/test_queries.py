"""Every query with an oracle against DuckDB on the smallest tables, and the command line."""

import os

import duckdb
import pytest

from tagstream import cli
from tagstream.plans import catalog
from tests.test_fields import message

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_like_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    theirs = sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in got.fetchall())
    assert mine == theirs


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_flagship(spark):
    df = catalog.flagship(spark, SF)
    assert df.count() > 0 and "flow" in df.columns


def run(capsys, *argv):
    code = cli.main([*argv, "--master", "local[2]"])
    return code, capsys.readouterr()


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "x.log"
    body = "35=D|49=A|56=B|34=1|52=20240102-10:00:00|11=c|1=acc|21=1|55=S|54=1|60=20240102-10:00:00|38=100|40=1"
    path.write_text(f"t {message(body)}\nnone\n{message('35=8|37=1|11=c|39=2')}\n", newline="")
    code, out = run(capsys, "decode", str(path))
    assert code == 0 and "  54 (Side): 1 (BUY)" in out.out and "|35=D|" in out.out
    code, out = run(capsys, "counts", str(path), "/nonexistent.log")
    assert code == 1 and "Order Flow\tD\tNewOrderSingle\t1" in out.out and "/nonexistent.log" in out.err
    code, out = run(capsys, "validate", str(path))
    assert len(out.out.strip().splitlines()) == 1 and "required tag" in out.out
    code, out = run(capsys, "summary", str(path))
    assert "Filled" in out.out
    code, out = run(capsys, "redact", str(path))
    assert (tmp_path / "x.secret.log").exists() and "SenderCompID0001" in (tmp_path / "x.secret.log").read_text()
    code, out = run(capsys, "tree", "FIX44", "Parties")
    assert "NoPartyIDs" in out.out
    code, out = run(capsys, "messages", "FIX44")
    assert "Session/Admin\t0\tHeartbeat" in out.out
    code, out = run(capsys, "info")
    assert "FIXT11" in out.out
    code, out = run(capsys, "tags", "FIXT11")
    assert "1137\tDefaultApplVerID\tSTRING" in out.out
