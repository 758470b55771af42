"""Work at hubs that grows with their trains and not with their pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import trains
from tidemark.operators import asof, labels, pairs, profile

PLAN = "eva string, stop_id string, event string, trip string, pt timestamp, pp string, line string, path string, wings string, tra string, cat string, num string, first_seen timestamp"
T0 = dt.datetime(2026, 9, 24, 22, 30)


def random_plan(spark, n, seed, minutes=200):
    r = random.Random(seed)
    way = lambda: r.choice([None, "", "|".join(r.sample("ABCDEFGH", r.randint(1, 3)))])
    rows = []
    for i in range(n):
        t = T0 + dt.timedelta(minutes=r.randint(0, minutes) + r.choice([0, 0, 0.5]))
        rest = lambda: (r.choice("xyz"), "L", way(), r.choice([None, "u1|u2", "u3"]), r.choice([None, f"{r.randint(0, n)}-1", "u4-7"]), r.choice(["RE", "RE", "S", None, "Bus"]), str(i), T0)
        event = r.choice(["ar", "dp"])
        rows.append((r.choice(["1", "1", "2", None]), f"{i}-1", event, r.choice([None, *[f"u{k}" for k in range(9)]]), None if r.random() < 0.02 else t, *rest()))
        if event == "ar" and r.random() < 0.3:
            rows.append((rows[-1][0], f"{i}-1", "dp", rows[-1][3], t + dt.timedelta(minutes=3), *rest()))
    return spark.createDataFrame(rows, PLAN)


@pytest.mark.parametrize(("direct", "low", "high"), [(0.0, 4, 60), (0.0, 0, 150), (4.0, 4, 30)])
def test_connections_are_the_candidates_of_all_pairs(spark, direct, low, high):
    hubs = spark.createDataFrame([("1", "One"), ("2", "Two"), ("3", "None")], "eva string, hub string")
    p = random_plan(spark, 400, 5).cache()
    bounds = (F.lit(T0 + dt.timedelta(minutes=10)), F.lit(T0 + dt.timedelta(minutes=180)))
    want = pairs.candidates(pairs.judged_pairs(p, hubs, *bounds, low, high), hubs)
    got = pairs.connections(p, hubs, *bounds, low, high, direct)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 100


def test_connections_list_no_pairs(spark):
    """A hub with 300 trains either way in an hour: 45,000 pairs and more, and each arrival has a few connections."""
    rows = [("1", f"{e}{i}-1", e, f"{e}{i}", T0 + dt.timedelta(seconds=12 * i), "1", "L", f"S{i % 7}|S{i % 5}", None, None, "RE", str(i), T0) for i in range(300) for e in ("ar", "dp")]
    hubs = spark.createDataFrame([("1", "One")], "eva string, hub string")
    p = spark.createDataFrame(rows, PLAN)
    df = pairs.connections(p, hubs, None, None, 4, 60)
    assert 300 < df.count() < 300 * 7
    met = pairs.first_departures(*pairs._sides(p, hubs, None, None), 4, 60)
    assert met.count() <= 300 * 7


def test_distinct_keys_are_counted_without_a_row_a_key(spark):
    rows = spark.createDataFrame([(1, 1), (1, None), (None, None), (None, None)], "a int, b int")
    out = profile.uniqueness(rows, {"a": ["a"], "a,b": ["a", "b"]})
    assert sorted(map(tuple, out.collect())) == [("a", 4, 2), ("a,b", 4, 3)]
    assert "Expand" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in profile.uniqueness(rows.limit(0), {"a": ["a"]}).collect()] == [("a", 0, 0)]


def test_pairs_are_judged_once_a_rule(spark):
    """The condition of a passed pair names each rule once; flags made out of flags doubled it with every rule."""
    hubs = spark.createDataFrame([("1", "One")], "eva string, hub string")
    p = random_plan(spark, 20, 1)
    plan = pairs.judged_pairs(p, hubs).where("passed").select("slack_min")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("= Bus") <= 4


def test_paths_are_taken_apart_in_generated_code(spark):
    rows = spark.createDataFrame([(None, []), ("", []), ("|", []), ("A||B|", ["A", "B"]), ("A.|*B", ["A.", "*B"])], "text string, want array<string>")
    out = rows.select("want", trains.path(F.col("text")).alias("got"))
    assert all(r["got"] == r["want"] for r in out.collect())
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_departures_are_asked_for_once_a_time_of_their_arrivals(spark, monkeypatch):
    """Ten arrivals and ten departures of one time each, all connected: 100 pairs, but 10 departures at 3 cutoffs."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    made = [("1", f"a{i}", f"d{j}", i, None if j == 9 else 100 + j, at(0), at(10), T0 - dt.timedelta(days=1)) for i in range(10) for j in range(10)]
    p = spark.createDataFrame(made, "eva string, stop_id_a string, stop_id_b string, key_a long, key_b long, pt_a timestamp, pt_b timestamp, first_seen_b timestamp").withColumn("first_seen_a", F.col("first_seen_b"))
    obs = spark.createDataFrame([(k, at(-m), at(m + k % 7), "c" if k == 104 else None) for k in (*range(9), *range(100, 109)) for m in (70, 20)], "key long, obs timestamp, ct timestamp, cs string")
    asked = []

    def spied(queries, *rest, **named):
        asked.append(queries.count())
        return asof.asof_join(queries, *rest, **named)

    monkeypatch.setattr(labels, "asof_join", spied)
    rows = labels.at_cutoffs(labels.with_labels(p, obs), obs, obs.select(F.lit("1").alias("eva"), F.col("obs").alias("t"))).collect()
    assert asked == [30, 30] and len(rows) == 300
    for r in rows:
        last = max((m for m in (70, 20) if m >= r["cutoff_min"]), default=None) if r["cutoff_min"] > 20 else 20
        for side, lacks in (("a", r["key_a"] == 9), ("b", r["key_b"] is None)):
            want = None if lacks or last is None else (at(-last), at(last + r[f"key_{side}"] % 7))
            assert (None if r[f"{side}_obs_cut"] is None else (r[f"{side}_obs_cut"], r[f"{side}_ct_cut"])) == want


def test_summary_makes_its_rows_once(spark):
    rows = spark.createDataFrame([(60, True, i % 3 == 0, float(i % 7), float(i % 5), i % 11 == 0) for i in range(60)], "cutoff_min int, eligible boolean, label_fail boolean, planned_slack_min double, db_slack_min double, b_cancel_known boolean")
    out = labels.summary(rows)
    assert "ExistingRDD" not in out._jdf.queryExecution().toString() and out.first()["rows"] == 60
