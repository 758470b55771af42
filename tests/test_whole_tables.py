"""Queries that read whole tables, against SQL that filters nothing."""

import os

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def both(spark, name, sql):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, SF).collect()), sorted(con.sql(sql).fetchall())


def test_missing_days_are_those_without_any_order(spark):
    got, want = both(spark, "missing_order_days", """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
        SELECT strftime(g, '%Y-%m-%d') FROM (SELECT unnest(generate_series((SELECT min(d) FROM d), (SELECT max(d) FROM d), INTERVAL 1 DAY))::DATE AS g) WHERE g NOT IN (SELECT d FROM d)""")
    assert got == want and got


def test_skew_compares_all_orders(spark):
    got = {r["feature"]: r["rows"] for r in __spark_entry__.queries()["feature_skew"](spark, SF).collect()}
    assert got == dict.fromkeys(("price", "month", "<row>"), spark.read.parquet(f"{SF}/orders.parquet").count())


def test_no_prediction_lacks_its_outcome(spark):
    got = __spark_entry__.queries()["prediction_outcomes"](spark, SF).agg({"predictions": "sum", "evaluated": "sum", "excluded": "sum", "not_a_candidate": "sum"}).first().asDict()
    _, want = both(spark, "missing_order_days", """WITH k AS (SELECT l_linenumber = 5 AS out FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber)
        SELECT count(*), count(*) FILTER (NOT out), count(*) FILTER (out), 0 FROM k""")
    assert tuple(got[f"sum({c})"] for c in ("predictions", "evaluated", "excluded", "not_a_candidate")) == want[0]


def test_periods_hold_all_years(spark):
    got, want = both(spark, "period_pivot", "SELECT o_orderpriority, year(o_orderdate), round(avg(o_totalprice), 6) FROM orders GROUP BY ALL")
    assert [r[:2] for r in got] == [r[:2] for r in want] and {r[1] for r in got} >= set(range(1995, 2002))
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])
