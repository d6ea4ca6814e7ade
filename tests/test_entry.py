"""The registered queries against their SQL on the smallest table, the command line, and the entry points."""

import os
from collections import Counter

import duckdb
import pytest
from tracelode import cli
from tracelode.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = Counter(tuple(r[c] for c in cols) for r in df.collect())
    if name in Q.ORACLE_SQL:
        want = duck.sql(Q.ORACLE_SQL[name])
        place = [want.columns.index(c) for c in cols]
        assert sorted(want.columns) == cols and rows == Counter(tuple(r[i] for i in place) for r in want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries()) and set(Q.QUERIES) <= set(E.queries())


def run(capsys, spark, *argv):
    assert cli.main(list(argv), spark) == 0
    return capsys.readouterr().out


def test_command_line(spark, capsys, tmp_path):
    h = "563DE3D2F07D0747BBE4BA2697AE33AA"
    assert f"LM hash: {h}" in run(capsys, spark, h, "-t", "win")
    assert "[lm at 0, confident: 80]" in run(capsys, spark, h, "-t", "win,web", "-a", "-m", "80")
    assert run(capsys, spark, h, "-t", "win", "-v1", "has:LOWER") == ""
    assert "MD5 digest" in run(capsys, spark, "0x" + h, "-t", "web", "-v1", "search:^563", "-v2", "all:NUMERIC")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.txt").write_text(f"x {h} y")
    (tmp_path / "b.log").write_text(f"{h}")
    assert "LM hash" in run(capsys, spark, "-f", str(tmp_path / "b.log"), "-t", "win")
    out = run(capsys, spark, "-d", str(tmp_path), "-r", "-fp", "*.txt", "-t", "win")
    assert "== file: " in out and "a.txt" in out and "b.log" not in out
    assert "after decode hex: LM hash" in run(capsys, spark, h.encode().hex(), "-t", "win", "-g", "decode")
    assert "Phone number: 825373491" not in run(capsys, spark, "1234", "-p", "<I")
    assert "whirlpool" in run(capsys, spark, "-l")
    assert "usage" in run(capsys, spark)
    found = cli.findings(spark, cli.parser().parse_args(["-s", "-t", "personal"]), ["000-000-0000\n", "nothing\n"])
    assert [r.payload for r in found.collect()] == [["000-0000"]]
