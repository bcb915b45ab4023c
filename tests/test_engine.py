"""Order of results, layers of tables, exact division, joins by time: against plain Python."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from millrace.dialect.lexer import DialectError
from millrace.dialect.parser import parse
from millrace.operators.asof import asof_join, interval_join
from millrace.plans import catalogue
from millrace.session import Session
from millrace.sources import store, wire
from tests.oracle import DATA, connect, plain


@pytest.mark.parametrize("name", ["so1_order_by", "so4_order_by_alias", "so4_order_by_ordinal", "so5_nulls_lowest", "so5_nulls_first_last", "so6_limit", "sc6_ordered_scan", "ag15_order_by_aggregate", "flagship_group_select"])
def test_rows_come_in_order(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    got = [tuple(map(plain, r)) for r in df.collect()]
    assert got == [tuple(map(plain, r)) for r in connect().sql(catalogue.oracle_sql()[name]).fetchall()]


def test_no_check_is_vacuous():
    """Every check but that of the empty table compares rows."""
    con = connect()
    assert [k for k, sql in catalogue.oracle_sql().items() if not con.sql(sql).limit(1).fetchall()] == ["sc4_empty"]


def test_layers_hold_what_a_list_would(spark, monkeypatch):
    monkeypatch.setattr(store, "LAYERS", 4)
    s = Session(spark)
    s.sql("CREATE TABLE t (k INTEGER, v VARCHAR(5))")
    rows: list[tuple] = []
    rng = np.random.default_rng(1)
    for step in range(9):
        k = int(rng.integers(0, 4))
        if step % 3 == 0:
            s.sql(f"INSERT INTO t VALUES ({k}, 'a{step}'), ({k + 1}, NULL)")
            rows += [(k, f"a{step}"), (k + 1, None)]
        elif step % 3 == 1:
            s.sql(f"UPDATE t SET v = 'u{step}' WHERE k = {k}")
            rows = [(a, f"u{step}" if a == k else b) for a, b in rows]
        else:
            s.sql(f"DELETE FROM t WHERE k = {k}")
            rows = [r for r in rows if r[0] != k]
        assert len(s.transaction.tables[("APP", "t")].layers) <= 4
    assert sorted(map(tuple, s.sql("SELECT k, v FROM t").collect()), key=repr) == sorted(rows, key=repr)


def test_inserts_write_their_rows_alone(spark):
    s = Session(spark)
    s.sql("CREATE TABLE t (k INTEGER); INSERT INTO t VALUES (1)")
    first = set(s.transaction.tables[("APP", "t")].df.inputFiles())
    s.sql("INSERT INTO t VALUES (2)")
    assert first <= set(s.transaction.tables[("APP", "t")].df.inputFiles())


def test_division_is_exact(spark):
    rng = np.random.default_rng(2)
    cases = []
    for _ in range(60):
        (p, s), (q, t) = ((int(rng.integers(1, 16)), int(rng.integers(0, 6))) for _ in range(2))
        a, b = (Decimal(int(rng.integers(-(10**d), 10**d))).scaleb(-e) for d, e in ((min(p, 12), s), (min(q, 9), t)))
        cases.append((a, b))
    s = Session(spark)
    for a, b in cases:
        got = s.scalar(f"SELECT {a:f} / {b:f}" if b >= 0 else f"SELECT {a:f} / ({b:f})")
        want = None if b == 0 else (a / b).quantize(Decimal(1).scaleb(-10), ROUND_HALF_UP)
        assert got == want, (a, b)
    assert s.scalar("SELECT CAST('NaN' AS DOUBLE) / 2") != s.scalar("SELECT 1.5 / 2")


def test_views_are_dropped_on_close(spark):
    before = len(spark.catalog.listTables())
    with Session(spark, DATA) as s:
        s.sql("SELECT count(*) FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey").collect()
        assert len(spark.catalog.listTables()) == before + 2
    assert len(spark.catalog.listTables()) == before


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT 1 FROM", "SELECT a FROM t WHERE", "SELECT a FROM t GROUP", "INSERT INTO t", "UPDATE t a = 1", "CREATE TABLE t", "CREATE TABLE t (a NOTHING)", "ALTER TABLE t RENAME", "SELECT row_number() OVER (ROWS BETWEEN x AND y)", "SELECT CAST(1 AS)"])
def test_bad_text_is_refused(spark, text):
    with pytest.raises((DialectError, ValueError)):
        Session(spark).sql(text)


def test_wire_round_trip():
    params = {"a": Decimal("1.50"), "b": datetime(2001, 12, 22, 1, 2, 3), "c": None, "d": "ü", "e": b"\x00\xff", "f": True, "g": datetime(2001, 1, 1).date()}
    assert wire.unpacked(wire.packed("SELECT 'x'", params)) == ("SELECT 'x'", params)
    assert wire.unpacked(wire.packed("SELECT ?", [1, 2.5])) == ("SELECT ?", [1, 2.5])
    with pytest.raises(ValueError):
        wire.unpacked(b'{"version": 9}')


def test_statements_of_a_text():
    assert [s.kind for s in parse("COMMIT WORK; ROLLBACK; ROLLBACK WORK; COMMIT; SHOW TABLES; DESCRIBE t; DROP INDEX i ON t")] == ["commit", "rollback", "rollback", "commit", "show_tables", "describe", "drop_index"]


def test_joins_by_time_are_brute_force(spark):
    rng = np.random.default_rng(3)
    start = datetime(2020, 1, 1)
    rows = lambda n: [(i, [None, "a", "b"][rng.integers(3)], start + timedelta(minutes=int(rng.integers(0, 300)))) for i in range(n)]
    left, right = rows(80), rows(60)
    a = spark.createDataFrame(left, "x bigint, k string, t timestamp_ntz")
    b = spark.createDataFrame(right, "y bigint, k string, t timestamp_ntz")
    got = {r.x: r.y for r in asof_join(a, b, "t", ["k"], within="INTERVAL 40 MINUTES").collect()}
    for x, k, t in left:
        before = [(s, y) for y, j, s in right if j == k and s < t]
        last = max(before, default=None)
        assert got[x] == (last[1] if last and last[0] >= t - timedelta(minutes=40) else None)
    pairs = {(r.x, r.y) for r in interval_join(a, b.withColumnRenamed("t", "at"), "t", "at", 1200, ["k"]).collect()}
    assert pairs == {(x, y) for x, k, t in left for y, j, s in right if k is not None and j == k and t <= s < t + timedelta(seconds=1200)}
