"""Every registered query with SQL gives DuckDB's rows on the smallest tables, where those are enough for it."""

import math
import os

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries that fit models, for which the smallest tables have no eligible row.
FITTED = ("bundle_card", "bundle_profile", "live_failure_rates", "scored_stream")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder):
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return f"{float(v):.5f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_against_sql(spark, name):
    folder = LARGER if name in FITTED else SF
    con = connected(folder)
    got = __spark_entry__.queries()[name](spark, folder)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


@pytest.mark.parametrize("name", ["calibrated_baselines", "tuned_settings", "narrowed_settings", "chosen_groups", "all_feature_groups"])
def test_without_sql(spark, name):
    if not os.path.isdir(LARGER):
        pytest.skip("no test tables")
    assert __spark_entry__.queries()[name](spark, LARGER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_years_left_out(spark):
    if not os.path.isdir(LARGER):
        pytest.skip("no test tables")
    got = {r["inputs"]: r for r in __spark_entry__.queries()["dropped_groups"](spark, LARGER).collect()}
    lines = connected(LARGER).sql("SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()[0][0]
    assert set(got) == {"all", "without score", "without base", "without place"}
    assert {r["n"] for r in got.values()} == {lines}  # every year is predicted once
    assert all(0 < r["log_loss"] < 0.7 and 0.4 < r["auc"] < 0.6 for r in got.values())  # labels are random here
