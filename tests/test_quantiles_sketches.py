"""Exact quantiles by selection, stored daily sketches, snapshots of latest versions."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, sketches, snapshots
from tidemark.operators.asof import latest_version
from tidemark.operators.quantiles import exact_quantiles, quantile_columns

AT = (0.0, 0.1, 0.25, 0.5, 0.5, 0.9, 0.99, 1.0)


def given():
    r = random.Random(3)
    groups = {"wide": [r.gauss(0, 1e6) for _ in range(6000)], "tied": [float(r.randrange(7)) for _ in range(5000)], "one": [4.5], "same": [2.0] * 900, "two": [1.0, 3.0], None: [float(x * x) for x in range(12)]}
    return groups, [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None), ("wide", float("nan")), ("none", None)]


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_equal_those_of_plain_code(spark, accuracy):
    """Small accuracy makes the cut points narrow a search, large searches whole groups: the same numbers."""
    groups, rows = given()
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", AT, accuracy).collect()}
    assert set(got) == {*groups, "none"}
    assert got["none"]["n"] == 0 and got["none"]["quantiles"] == [None] * len(AT)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        assert got[g]["quantiles"] == pytest.approx(list(np.percentile(values, [100 * q for q in AT])), rel=1e-12, abs=1e-9), g


def test_median_of_one_large_group(spark):
    """60,000 rows at accuracy 1,000: the search goes by cut points."""
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).cast("double").alias("x"))
    out = exact_quantiles(df, [], "x", (0.5,), 1_000)
    assert out.first()["quantiles"] == [29_999.5]


def test_more_groups_than_are_broadcast(spark):
    """1,500 groups, one of which holds most rows."""
    rows = spark.range(9_000).select(F.when(F.col("id") < 6_000, F.lit(-1)).otherwise(F.col("id") % 1_500).alias("g"), (F.col("id") * 31 % 1009).cast("double").alias("x"))
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(rows, ["g"], "x", (0.5, 0.9)).collect()}
    want = {r["g"]: [r["a"], r["b"]] for r in rows.groupBy("g").agg(F.percentile("x", 0.5).alias("a"), F.percentile("x", 0.9).alias("b")).collect()}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g]) for g in want)


def test_odd_inputs_of_quantiles(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert exact_quantiles(empty, ["g"], "x", (0.5,)).collect() == []
    assert exact_quantiles(empty, [], "x", (0.5,)).first()["quantiles"] == [None]
    with pytest.raises(ValueError):
        exact_quantiles(empty, ["g"], "x", ())
    clash = spark.createDataFrame([("a", 1.0, 5), ("a", 3.0, 6)], "_k0 string, n double, _rows int")
    got = exact_quantiles(clash, ["_k0"], "n", (0.5,)).first()
    assert got["_k0"] == "a" and got["quantiles"] == [2.0]
    wide = quantile_columns(clash, ["_k0"], {"n": ("n", (0.5,)), "r": ("_rows", (0.0, 1.0))}).first()
    assert (wide["n_p50"], wide["r_p00"], wide["r_p100"]) == (2.0, 5.0, 6.0)


def profiled(spark):
    r = random.Random(5)
    rows = [(d, r.gauss(d / 10, 1), float(r.randrange(5)), "ab"[r.randrange(2)] if r.random() > 0.1 else None) for d in range(1, 7) for _ in range(4000)] + [(1, None, float("nan"), "z")]
    return spark.createDataFrame(rows, "day int, x double, few double, kind string")


def test_profiles_of_days_merge_to_the_whole(spark, tmp_path):
    rows = profiled(spark)
    sketches.daily_profiles(rows, "day", ["x", "few"], ["kind"]).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    for days in ((1, 2, 3), (1, 2, 3, 4, 5, 6)):
        part = rows.where(F.col("day").isin(*days)).toPandas()
        merged = sketches.merged_profiles(stored.where(F.col("day").isin(*days)))
        got = {r["input"]: r for r in merged.where("kind = 'numeric'").withColumn("d", F.hll_sketch_estimate("different")).collect()}
        assert (got["x"]["rows"], got["x"]["missing"], got["few"]["missing"], got["few"]["d"]) == (len(part), 1, 1, 5)
        assert (got["x"]["low"], got["x"]["high"]) == (part.x.min(), part.x.max())
        assert got["x"]["d"] == pytest.approx(part.x.nunique(), rel=0.06)
        values, at = np.sort(part.x.dropna()), (0.01, 0.25, 0.5, 0.9)
        for q, v in zip(at, sketches.profile_quantiles(merged, at).where("input = 'x'").first()["quantiles"], strict=True):
            assert abs(np.searchsorted(values, v, "right") / len(values) - q) < 0.005


def test_psi_of_stored_profiles(spark):
    """Against PSI over the rows, whose edges and shares are exact; shares of categories are equal."""
    rows = profiled(spark)
    stored = sketches.daily_profiles(rows, "day", ["x"], ["kind"])
    old, new = (sketches.merged_profiles(stored.where(w)) for w in ("day <= 3", "day > 3"))
    edges = sketches.profile_edges(old)
    got = {r["input"]: r["psi"] for r in drift.psi(sketches.profile_shares(old, edges), sketches.profile_shares(new, edges)).collect()}
    a, b = rows.where("day <= 3"), rows.where("day > 3")
    bounds = drift.edges(a, ["x"], exact=True)
    want = {r["input"]: r["psi"] for r in drift.psi(drift.shares(a, ["x"], ["kind"], bounds), drift.shares(b, ["x"], ["kind"], bounds)).collect()}
    assert got["x"] == pytest.approx(want["x"], abs=0.01) and want["x"] > 0.05
    assert got["kind"] == pytest.approx(want["kind"])
    sums = sketches.profile_shares(new, edges).groupBy("input").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)


def test_profiles_without_rows_or_numbers(spark):
    none = spark.createDataFrame([(1, None, "a")], "day int, x double, kind string")
    merged = sketches.merged_profiles(sketches.daily_profiles(none, "day", ["x"], ["kind"]))
    edges = sketches.profile_edges(merged)
    assert edges.first()["edges"] == []
    assert sorted((r["input"], r["bin"], r["share"]) for r in sketches.profile_shares(merged, edges).collect()) == [("kind", "a", 1.0), ("x", drift.MISSING, 1.0)]
    assert sketches.merged_profiles(sketches.daily_profiles(none.limit(0), "day", ["x"], ["kind"])).collect() == []


def test_snapshots_equal_the_whole_log_and_read_only_dates_since(spark, tmp_path):
    r = random.Random(9)
    start = datetime.datetime(2024, 3, 1)
    rows = []
    for i in range(1500):
        t = start + datetime.timedelta(minutes=r.randrange(6 * 1440))
        rows.append((t.date(), r.choice(["k1", "k1", "k2", None, f"k{r.randrange(40)}"]), t, r.choice([None, "a", "b"]), r.choice([None, 1.5, 2.5]), i))
    spark.createDataFrame(rows, "date date, key string, at timestamp, line string, delay double, n int").write.partitionBy("date").parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    how = (["key"], "at", ["line", "delay"], ["n"])
    path = str(tmp_path / "snapshots")
    t = F.lit(start + datetime.timedelta(days=4, hours=13))
    want = sorted(map(str, latest_version(log.where(F.col("at") <= t), *how).collect()))
    assert sorted(map(str, snapshots.latest_at(log, path, t, "2024-03-05", *how).collect())) == want
    for day in ("2024-03-02", "2024-03-04", "2024-03-04", "2024-03-05"):
        snapshots.write_snapshot(log, path, day, *how)
    (tmp_path / "snapshots" / "as_of=2024-03-04" / "half").mkdir()
    for old in (tmp_path / "log").glob("date=2024-03-0[1-4]/*.parquet"):
        old.write_bytes(b"not parquet")  # whoever reads it fails
    fresh = spark.read.schema(log.schema).parquet(str(tmp_path / "log"))
    assert snapshots.last_snapshot(spark, path, "2024-03-05") == "2024-03-04"
    assert sorted(map(str, snapshots.latest_at(fresh, path, t, "2024-03-05", *how).collect())) == want
