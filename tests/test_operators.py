"""Operators on hand-made rows: edges, ties, nulls, and that the future changes nothing."""

import hashlib
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import times, trains
from tidemark.operators import asof, drift, features, folds, grid, labels, metrics, models, monitor, pairs, profile

T0 = datetime(2026, 9, 24, 6, 0)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def values(df, expr):
    return df.select(expr).first()[0]


def test_local_times(spark):
    one = spark.range(1)
    utc = lambda s: values(one, times.raw_to_utc(F.lit(s)).cast("string"))
    assert utc("2609241012") == "2026-09-24 08:12:00" and utc("2601241012") == "2026-01-24 09:12:00"
    assert utc("2610250230") == "2026-10-25 00:30:00"  # the repeated hour: its first pass
    assert utc("bad") is None and utc("2613011200") is None and utc("") is None
    amb = lambda s: values(one, times.is_ambiguous(F.lit(s)))
    assert amb("2610250230") and amb("2603290230") and not amb("2609241012") and not amb("26") and not amb("2610250330")
    day = lambda s: str(values(one, times.service_day(F.lit(s).cast("timestamp"))))
    assert day("2026-09-24 01:59:00") == "2026-09-23" and day("2026-09-24 02:00:00") == "2026-09-24"
    hours = lambda d: values(one, times.minutes(times.day_start(F.date_add(F.lit(d).cast("date"), 1)), times.day_start(F.lit(d).cast("date")))) / 60
    assert (hours("2026-10-24"), hours("2026-03-28"), hours("2026-09-24")) == (25, 23, 24)


def test_train_functions(spark):
    one = spark.range(1)
    assert values(one, trains.trip_key(F.lit("-771222-2609231800-1"))) == "-771222-2609231800"
    assert values(one, trains.trip_key(F.lit(""))) is None
    assert values(one, trains.path(F.lit("A||B|"))) == ["A", "B"] and values(one, trains.path(F.lit(None).cast("string"))) == []
    assert [values(one, trains.segment(F.lit(c).cast("string"))) for c in ("S", "ICE", "RB", None)] == ["S-Bahn", "long-distance", "regional", "unknown"]
    assert [values(one, trains.bucket(F.lit(x).cast("double"), (0, 5, 10))) for x in (-1, 0, 4.9, 5, 10, None)] == [-1, 0, 0, 1, -1, -1]
    assert [values(one, trains.nearest_cutoff(F.lit(x), (60, 30, 10))) for x in (5, 20, 45, 46)] == [10, 10, 30, 60]
    assert values(one, trains.display_name(F.lit("RE"), F.lit("RE1"), F.lit("5"))) == "RE1" and values(one, trains.display_name(F.lit("RE"), F.lit(None).cast("string"), F.lit("5"))) == "RE 5"


OBS = "key string, obs timestamp, ct timestamp, cs string"


def test_asof_takes_whole_rows_and_is_inclusive(spark):
    obs = spark.createDataFrame([("a", at(0), at(5), None), ("a", at(10), None, "c"), ("a", at(20), at(9), None), ("a", at(20), at(8), None), (None, at(0), at(1), None)], OBS)
    asked = spark.createDataFrame([("a", at(-1)), ("a", at(0)), ("a", at(10)), ("a", at(30)), ("b", at(30)), (None, at(30)), ("a", None)], "key string, t timestamp")
    rows = asof.asof_join(asked, obs, ["key"], "t", "obs", ["ct", "cs"], tie=["ct", "cs"]).collect()
    got = {(r["key"], r["t"]): (r["ct"], r["cs"]) for r in rows}
    assert len(rows) == 7 and got["a", at(-1)] == (None, None) and got["a", at(0)] == (at(5), None)
    assert got["a", at(10)] == (None, "c") and got["a", at(30)] == (at(9), None)
    assert got["b", at(30)] == got[None, at(30)] == got["a", None] == (None, None)


def test_last_time_across_hours(spark):
    rng = random.Random(1)
    polls = [("x", at(rng.randrange(0, 3000) + rng.random())) for _ in range(60)] + [("y", at(5)), (None, at(1))]
    asked = [(i, rng.choice("xyz"), at(rng.randrange(-100, 3200))) for i in range(200)]
    out = asof.last_time(spark.createDataFrame(asked, "i int, eva string, q timestamp"), spark.createDataFrame(polls, "eva string, t timestamp"), "eva", "q", "t", "poll")
    got = {r["i"]: r["poll"] for r in out.collect()}
    for i, k, q in asked:
        assert got[i] == max((t for p, t in polls if p == k and t <= q), default=None)


def test_latest_version_skips_nulls(spark):
    rows = spark.createDataFrame([("s", at(0), "a", 1), ("s", at(1), None, 2), ("s", at(2), "b", None)], "k string, t timestamp, x string, n int")
    r = asof.latest_version(rows, ["k"], "t", ["x", "n"]).first()
    assert (r["x"], r["n"], r["first_seen"]) == ("b", 2, at(0))


def plan_rows(spark, rows):
    schema = "eva string, stop_id string, event string, trip string, pt timestamp, pp string, line string, path string, wings string, tra string, cat string, num string, first_seen timestamp"
    full = []
    for r in rows:
        d = dict(eva="1", trip=r["stop_id"], pp="1", line=None, path=None, wings=None, tra=None, cat="RE", num="1", first_seen=at(-600)) | r
        full.append(tuple(d[c.split(" ")[0]] for c in schema.split(", ")))
    return spark.createDataFrame(full, schema)


def judged(spark, rows):
    hubs = spark.createDataFrame([("1", "Hub")], "eva string, hub string")
    j = pairs.judged_pairs(plan_rows(spark, rows), hubs, F.lit(at(0)), F.lit(at(600)), 4, 30)
    return j, hubs


def test_slack_edges_and_first_reach(spark):
    a = dict(stop_id="a-1", event="ar", pt=at(0), path="P|Q", trip="a")
    deps = [("d3", 3, "X"), ("d4", 4, "X"), ("d30", 30, "X|Y"), ("d31", 31, "Z"), ("e30", 30, "Y"), ("f9", 9, "P"), ("g20", 20, "X")]
    j, hubs = judged(spark, [a, *[dict(stop_id=f"{n}-1", event="dp", pt=at(m), path=p, trip=n) for n, m, p in deps]])
    assert {r["stop_id_b"] for r in j.collect()} == {"d4-1", "d30-1", "e30-1", "f9-1", "g20-1"}
    kept = {r["stop_id_b"] for r in pairs.candidates(j, hubs).collect()}
    assert kept == {"d4-1", "d30-1", "e30-1"}  # both of minute 30 reach Y; P was passed, X reached at 4


def test_rules_one_by_one(spark):
    arrive = dict(stop_id="a-1", event="ar", pt=at(0), trip="a", path="P|Q", tra="n-9", wings="w")
    onward = dict(stop_id="a-1", event="dp", pt=at(1), trip="a", path="C1|C2")
    cases = {"bus": dict(cat="Bus"), "same": dict(trip="a"), "transition": dict(trip="n"), "wings": dict(trip="w"), "back": dict(path="X|Q"), "redundant": dict(path="C2"), "fine": {}, "nocat": dict(cat=None)}
    rows = [arrive, onward, *[dict(stop_id=f"{n}-1", event="dp", pt=at(10), trip=n, path="X") | d for n, d in cases.items()]]
    j, hubs = judged(spark, rows)
    got = {r["stop_id_b"][:-2]: [k for k in ("T1", "T2", "T3", "T4", "T5", "T6") if r[k]] for r in j.collect() if r["stop_id_b"] != "a-1"}
    assert got == {"bus": ["T1"], "same": ["T2"], "transition": ["T3"], "wings": ["T4"], "back": ["T5"], "redundant": ["T6"], "fine": [], "nocat": []}
    f = {(r["hub"], r["step"]): r["pairs"] for r in pairs.funnel(j, pairs.first_reach(j.where("passed")), hubs).collect()}
    assert f["Hub", "window"] == 8 and f["total", "T6 redundant"] == 2 and f["Hub", "T7 first reach"] == 2


def test_interval_join_has_no_nested_loop(spark):
    df = spark.createDataFrame([("1", at(0))], "eva string, pt timestamp")
    plan = pairs.interval_join(df, df, "eva", "pt", 0, 60)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        pairs.interval_join(df, df, "eva", "pt", 5, 1)


def one_day(spark):
    """Three trains at one hub: A reaches it, B1 leaves 10 minutes later, B2 23 minutes later and is cancelled in the end."""
    p = plan_rows(
        spark,
        [
            dict(stop_id="a-5", event="ar", pt=at(132), trip="a", path="Aachen|Koeln West"), dict(stop_id="a-5", event="dp", pt=at(135), trip="a", path="Deutz|Duesseldorf"),
            dict(stop_id="b-1", event="dp", pt=at(145), trip="b", path="Siegburg|Frankfurt", cat="ICE"), dict(stop_id="c-1", event="dp", pt=at(158), trip="c", path="Deutz|Siegen"),
        ],
    )
    obs = spark.createDataFrame([("a", at(60), at(134), None), ("a", at(110), at(140), None), ("a", at(150), at(141), None), ("b", at(150), at(145), None), ("c", at(150), None, "c")], OBS)
    hubs = spark.createDataFrame([("1", "Hub")], "eva string, hub string")
    c = pairs.candidates(pairs.judged_pairs(p, hubs, F.lit(at(0)), F.lit(at(600))), hubs).withColumn("key_a", F.col("trip_a")).withColumn("key_b", F.col("trip_b"))
    polls = spark.createDataFrame([("1", at(m)) for m in range(0, 200, 10)], "eva string, t timestamp")
    return c, obs, polls


def test_labels_and_cutoffs(spark):
    c, obs, polls = one_day(spark)
    table = labels.at_cutoffs(labels.with_labels(c, obs), obs, polls)
    rows = table.collect()
    got = {(r["stop_id_b"], r["cutoff_min"]): r for r in rows}
    assert len(got) == 6 and all(r["eligible"] for r in rows)
    assert [got["b-1", c]["db_delay_a_min"] for c in (60, 30, 10)] == [2, 2, 8] and got["b-1", 10]["db_slack_min"] == 5
    assert (got["b-1", 60]["label_fail"], got["b-1", 60]["real_slack_min"]) == (False, 4)
    assert (got["c-1", 60]["label_fail"], got["c-1", 60]["fail_reason"]) == (True, "b_cancelled")
    s = {r["cutoff_min"]: r for r in labels.summary(table).collect()}
    assert s[60]["fail_pct"] == 50 and s[60]["auc_planned"] == 0.0


def test_the_future_changes_nothing(spark):
    c, obs, polls = one_day(spark)
    seen = ["a_ct_cut", "a_cs_cut", "b_ct_cut", "b_cs_cut", "db_slack_min", "collector_age_min"]
    until = at(132 - 30)
    later = obs.withColumn("ct", F.when(F.col("obs") > until, F.lit(at(999))).otherwise(F.col("ct"))).withColumn("cs", F.when(F.col("obs") > until, "c").otherwise(F.col("cs")))
    one, two = (sorted(map(tuple, labels.at_cutoffs(labels.with_labels(c, o), o, polls).where("cutoff_min >= 30").select("stop_id_b", "cutoff_min", *seen).collect()), key=str) for o in (obs, later))
    assert one == two


def test_exclusions_in_order(spark):
    df = spark.createDataFrame([(True, None), (None, True), (False, False)], "x boolean, y boolean")
    assert [r[0] for r in df.select(labels.first_reason({"a": F.col("x"), "b": F.col("y")})).collect()] == ["a", "b", None]
    assert set(labels.usage_columns("key", "label")) == {*labels.USAGE["key"], *labels.USAGE["label"]}
    with pytest.raises(ValueError):
        labels.usage_columns("nothing")
    every = [c for cs in labels.USAGE.values() for c in cs]
    assert len(every) == len(set(every))


def test_every_column_has_one_use(spark):
    c, obs, polls = one_day(spark)
    rows = labels.at_cutoffs(labels.with_labels(c, obs), obs, polls)
    rows = rows.select("*", *[F.lit(None).alias(x) for x in labels.usage_columns(*labels.USAGE) if x not in rows.columns and x != "service_day"])
    table = labels.training_table(rows)
    assert table.columns == labels.usage_columns(*labels.USAGE) and str(table.first()["service_day"]) == "2026-09-24"
    safe = labels.feature_safe(table).columns
    assert "db_slack_min" in safe and not set(safe) & {*labels.USAGE["label"], *labels.USAGE["quality"]}
    for wrong in (rows.withColumn("new", F.lit(1)), rows.drop("cat_a")):
        with pytest.raises(ValueError, match="uses without"):
            labels.training_table(wrong)


def test_model_within_a_percent_is_the_simpler(spark):
    losses = lambda *x: spark.createDataFrame(list(x), "model string, log_loss double")
    assert models.select_model(losses(("lr", 0.3029), ("gbt", 0.3)), ["lr", "gbt"]) == "lr"
    assert models.select_model(losses(("lr", 0.3031), ("gbt", 0.3)), ["lr", "gbt"]) == "gbt"
    assert models.select_model(losses(("rule", 0.1), ("lr", None), ("gbt", 0.3)), ["lr", "gbt"]) == "gbt"


def test_grid_windows(spark):
    p = plan_rows(spark, [dict(stop_id=f"s{m}", event="ar", pt=at(m), line="L", trip=f"s{m}") for m in (0, 30, 31, 60)] + [dict(stop_id="late", event="ar", pt=at(30), line="L", trip="x", first_seen=at(29))]).withColumn("key", F.col("trip"))
    obs = spark.createDataFrame([("s0", at(-5), at(10), None), ("s30", at(20), None, "c"), ("s31", at(55), at(41), None)], OBS)
    g = grid.events_on_grid(p, obs, F.lit(at(0)), F.lit(at(60)))
    hub = {r["g"]: r for r in grid.hub_state(g).collect()}
    line = {r["g"]: r["line_recent_delay_a"] for r in grid.line_state(g).collect()}
    assert hub[at(0)]["hub_mean_delay"] == 5.0 and hub[at(0)]["hub_share_cancel"] == 0.0  # s0 and s30 stand at its edges
    assert hub[at(30)]["hub_share_cancel"] == pytest.approx(1 / 5) and line[at(30)] == 5.0  # the last plan is known by now
    assert at(60) in line and line[at(60)] == pytest.approx((10 + 0 + 0) / 3)  # (0, 60]: s0 is out, s30 cancelled


def test_messages_freshness_trend(spark):
    rows = spark.createDataFrame([("r1", "a", at(30), at(90)), ("r2", "b", at(30), at(90))], "row string, key string, t_cut timestamp, pt timestamp")
    seen = features.message_sightings(spark.createDataFrame([("a", at(0), "d:1|d:2|"), ("a", at(30), "d:1|q:9"), ("a", at(31), "d:3"), ("b", at(1), None)], "key string, obs timestamp, m string"), "key", "m", "obs")
    got = {r["row"]: (r["d"], r["q"]) for r in features.messages(rows, seen, "row", "key", {"d": "d", "q": "q"}).collect()}
    assert got == {"r1": (2, 1), "r2": (0, 0)}
    obs = spark.createDataFrame([("a", at(10) + timedelta(seconds=59), at(93), None), ("a", at(20), at(95), None), ("a", at(30) + timedelta(seconds=1), at(99), None)], OBS)
    ages = {r["row"]: r["age"] for r in features.freshness(rows, obs, "key", "age").collect()}
    assert ages == {"r1": 10.0, "r2": None}
    trend = {r["row"]: (r["trend_a_15"], r["trend_a_30"]) for r in features.trend(rows, obs, "row", "key", "pt").collect()}
    assert trend == {"r1": (2.0, 5.0), "r2": (0.0, 0.0)}
    assert features.feature_columns(["db", "trend", "db"])[:4] == list(features.GROUPS["db"])
    with pytest.raises(ValueError):
        features.feature_columns(["nothing"])


def naive_auc(y, p):
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])) if pos and neg else None


def test_metrics_against_plain_code(spark):
    rng = random.Random(2)
    rows = [(rng.choice("gh"), int(rng.random() < 0.4), rng.choice([0.1, 0.2, rng.random()]), rng.randrange(6)) for _ in range(500)] + [("one", 1, 0.5, 0)]
    df = spark.createDataFrame(rows, "g string, y int, p double, day int")
    got = {r["g"]: r["auc"] for r in metrics.auc(df, ["g"], "y", "p").collect()}
    for g in ("g", "h", "one"):
        want = naive_auc([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g])
        assert got[g] is None if want is None else got[g] == pytest.approx(want)
    best = {r["g"]: (r["recall"], r["threshold"]) for r in metrics.recall_at_precision(df, ["g"], "y", "p", 0.41).collect()}
    for g in "gh":
        mine = [(y, p) for k, y, p, _ in rows if k == g]
        options = []
        for t in {p for _, p in mine}:
            flagged = [y for y, p in mine if p >= t]
            if sum(flagged) / len(flagged) >= 0.41:
                options.append((sum(flagged) / sum(y for y, _ in mine), t))
        assert best[g] == pytest.approx(max(options, key=lambda x: (x[0], -x[1])))  # of equal recalls the lowest threshold
    bins = metrics.reliability(df.union(spark.createDataFrame([("z", 1, 1.0, 0)], df.schema)), [], "y", "p").collect()
    assert max(r["bin"] for r in bins) == 9 and sum(r["n"] for r in bins) == 502
    rule = metrics.scores(df.withColumn("r", (F.col("p") > 0.5).cast("double")), ["g"], "y", "r").where("g = 'g'").first()
    assert rule["log_loss"] is None and rule["auc"] is None and rule["brier"] is not None


def test_bootstrap_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = 300
    day, y = rng.integers(0, 7, n), rng.integers(0, 2, n)
    m, b = np.clip(y * 0.4 + rng.random(n) * 0.6, 0.01, 0.99), np.round(rng.random(n) * 0.98 + 0.01, 2)
    df = spark.createDataFrame([(int(d), int(k), float(p), float(q)) for d, k, p, q in zip(day, y, m, b)], "day int, y int, m double, b double")
    r = metrics.bootstrap_gain(df, "day", "y", "m", "b", draws=50, auc_draws=10, seed=3).first()
    loss = lambda p: -(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert (r["days"], r["rows"]) == (7, 300) and r["log_loss_gain"] == pytest.approx(1 - loss(m).sum() / loss(b).sum())
    assert r["day_share"] == pytest.approx(np.mean([loss(m)[day == d].sum() < loss(b)[day == d].sum() for d in range(7)]))
    picks = [[int(hashlib.md5(f"3:{k}:{i}".encode()).hexdigest()[:8], 16) % 7 for i in range(7)] for k in range(50)]
    gains = [1 - sum(loss(m)[day == d].sum() for d in p) / sum(loss(b)[day == d].sum() for d in p) for p in picks]
    assert (r["log_loss_gain_low"], r["log_loss_gain_high"]) == pytest.approx(tuple(np.quantile(gains, [0.025, 0.975])))
    diffs = []
    for p in picks[:10]:
        i = np.concatenate([np.flatnonzero(day == d) for d in p])
        diffs.append(naive_auc(y[i], m[i]) - naive_auc(y[i], b[i]))
    assert (r["auc_diff_low"], r["auc_diff_high"]) == pytest.approx(tuple(np.quantile(diffs, [0.025, 0.975])))
    two = metrics.bootstrap_gain(df.withColumn("g", F.explode(F.array(F.lit("x"), F.lit("y")))), "day", "y", "m", "b", draws=50, auc_draws=10, seed=3, groups=["g"]).collect()
    assert {t["g"] for t in two} == {"x", "y"} and all(t["log_loss_gain_low"] == pytest.approx(r["log_loss_gain_low"]) for t in two)


def test_history_rates_fall_back(spark):
    rows = spark.createDataFrame([(0, "h", "s", 1), (0, "h", "s", 1), (0, "h", "t", 0), (1, "k", "s", 0)], "b int, hub string, seg string, y int")
    tables = models.history_rates(rows, "y", ["b", "hub", "seg"], 2.0)
    asked = spark.createDataFrame([(0, "h", "s"), (0, "h", "new"), (0, "new", "s"), (9, "h", "s")], "b int, hub string, seg string")
    got = {(r["b"], r["hub"], r["seg"]): r["p"] for r in models.predict_history(asked, tables, ["b", "hub", "seg"]).collect()}
    r1 = (2 + 2 * 0.5) / 5
    r2 = (2 + 2 * r1) / 5
    assert got[0, "h", "s"] == pytest.approx((2 + 2 * r2) / 4) and got[0, "h", "new"] == pytest.approx(r2) and got[0, "new", "s"] == pytest.approx(r1) and got[9, "h", "s"] == 0.5


def test_learners_find_the_signal(spark):
    rng = random.Random(5)
    rows = []
    for day in range(4):
        for _ in range(150):
            x, k = rng.gauss(0, 1), rng.choice("ab")
            rows.append((day, None if rng.random() < 0.1 else x, rng.random(), k, int(rng.random() < 1 / (1 + np.exp(-2 * x - (k == "a"))))))
    df = spark.createDataFrame(rows, "day int, x double, noise double, k string, y int").cache()
    makers = {"lr": lambda: models.Learner(["x", "noise"], ["k"]), "gbt": lambda: models.Learner(["x", "noise"], ["k"], kind="gbt", rounds=5)}
    out = models.predict_folds(df, "y", "day", folds.fold_table(df, "day", 3), makers).cache()
    assert out.count() == 150
    for name in makers:
        assert metrics.scores(out, [], "y", name).first()["auc"] > 0.75
    table = metrics.metric_table(out.withColumn("c", F.lit(1)), "y", ["lr", "gbt"], "c", [])
    assert models.select_model(table, ["lr", "gbt"]) == "lr"
    solo = {r["feature"]: r["auc"] for r in models.univariate(df, "y", ["x", "noise"]).collect()}
    assert solo["x"] > solo["noise"] >= 0.5
    for method in ("platt", "isotonic", "none"):
        fixed = models.calibrated(out, "y", "lr", method)(out)
        assert fixed.where("lr < 0 OR lr > 1 OR lr IS NULL").count() == 0
    unseen = df.limit(3).withColumn("k", F.lit("zz"))
    fitted = makers["lr"]().fit(df, "y")
    assert fitted.predict(unseen).where("p IS NULL").count() == 0
    scored = models.score_batch(df.limit(4).withColumn("status", F.when(F.col("day") == 0, "ok").otherwise("gap")), {"p": fitted})
    assert scored.where("(status = 'ok') <> (p IS NOT NULL)").count() == 0
    per = models.PerCutoff(makers["lr"], [0, 1], "day").fit(df, "y")
    with pytest.raises(ValueError):
        per.predict(df)
    assert per.predict(df.where("day < 2")).count() == 300


def test_settings_that_differ():
    assert models.settings_mismatch({"a": "1", "b": "2"}, {"a": "1", "c": "3"}) == [("b", "2", None), ("c", None, "3")]


def test_learners_of_constant_and_empty_columns(spark):
    rows = spark.createDataFrame([(None, 1.0, i % 2) for i in range(40)], "gone double, same double, y int")
    assert models.Learner(["gone", "same"]).fit(rows, "y").predict(rows).where("p < 0.4 OR p > 0.6").count() == 0
    with pytest.raises(ValueError, match="no labelled row"):
        models.Learner(["same"]).fit(rows.limit(0), "y")


def test_drift(spark):
    a = spark.createDataFrame([(float(i), "x" if i % 2 else "y") for i in range(300)] + [(None, None)] * 20, "n double, c string")
    same = {r["input"]: r for r in drift.drift_report(a, a, ["n"], ["c"], exact=True).collect()}
    assert all(r["psi"] == pytest.approx(0) and r["level"] == "stable" for r in same.values())
    far = {r["input"]: r for r in drift.drift_report(a, a.select((F.col("n") * 3).alias("n"), F.lit("new").alias("c")), ["n"], ["c"], skip=["c"]).collect()}
    assert far["n"]["level"] == "large" and far["c"]["status"] == "skipped" and far["c"]["psi"] is None
    assert {r["status"] for r in drift.drift_report(a, a.limit(5), ["n"], ["c"]).collect()} == {"too_few_rows"}


def test_monitoring(spark):
    log = spark.createDataFrame([("k", at(2), 0.2), ("k", at(1), 0.1), ("m", at(1), 0.3)], "key string, t timestamp, p double")
    first = monitor.first_logged(log, ["key"], "t")
    assert {(r["key"], r["p"]) for r in first.collect()} == {("k", 0.1), ("m", 0.3)}
    out = monitor.outcomes(first, spark.createDataFrame([("k", 1, False)], "key string, label int, eligible boolean"), ["key"])
    assert {(r["key"], r["outcome"]) for r in out.collect()} == {("k", "excluded"), ("m", "not_a_candidate")}
    live = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 2.0)], "k int, x double, y double")
    off = spark.createDataFrame([(1, 1.0 + 1e-9, None), (2, None, 2.5)], "k int, x double, y double")
    got = {r["feature"]: r["equal_share"] for r in monitor.skew(live, off, ["k"], ["x", "y"]).collect()}
    assert got == {"x": 1.0, "y": 0.5, "<row>": 0.5}
    days = spark.createDataFrame([(date(2026, 1, 1),), (date(2026, 1, 4),)], "d date")
    assert sorted(str(r["day"]) for r in monitor.missing_days(days, "d").collect()) == ["2026-01-02", "2026-01-03"]


def test_profiles(spark):
    reach = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 4)], "s string, x int")
    weights = spark.createDataFrame([(1, 5), (2, 1), (3, 1), (4, 2)], "x int, weight int")
    got = [(r["item"], r["added"], round(r["share"], 3)) for r in profile.greedy_cover(reach, "s", "x", weights, 5).orderBy("pick").collect()]
    assert got == [("a", 6.0, 0.667), ("c", 2.0, 0.889), ("b", 1.0, 1.0)]
    rng = np.random.default_rng(6)
    z = rng.normal(size=400)
    x, y = z + rng.normal(size=400), z + rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, z)], "x double, y double, z double")
    assert abs(profile.partial_correlation(df, "x", "y", ["z"]).first()["partial_corr"]) < 0.15
    assert profile.partial_correlation(df, "x", "y", []).first()["partial_corr"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    names = profile.closest_names(spark.createDataFrame([("Koln",), ("Bonn",)], "name string"), spark.createDataFrame([("Köln",), ("Bonn",), ("Ulm",)], "name string"), 1).collect()
    assert [(r["name"], r["close"]) for r in names] == [("Koln", "Köln")]
    assert profile.seeded_sample(df, "x", 7).count() == 7


@pytest.mark.parametrize("seed", [1, 2])
def test_asof_in_parts_equals_asof(spark, seed):
    rng = random.Random(seed)
    at = lambda: None if rng.random() < 0.05 else datetime(2025, 1, 1) + timedelta(minutes=rng.randint(0, 600))
    key = lambda: rng.choice(["hot"] * 8 + ["a", None])
    asked = spark.createDataFrame([(i, key(), at()) for i in range(150)], "q int, k string, t timestamp")
    facts = spark.createDataFrame([(key(), at(), rng.choice([None, 1, 2, 3]), rng.choice([None, "x"])) for _ in range(60)], "k string, at timestamp, v int, w string")
    for tie in (["v", "w"],):
        want = asof.asof_join(asked, facts, ["k"], "t", "at", ["v", "w"], tie)
        got = asof.asof_join_in_parts(asked, facts, ["k"], "t", "at", ["v", "w"], tie)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert asof.asof_join_in_parts(asked, facts.where("false"), ["k"], "t", "at", ["v"], ["v"]).where("at IS NULL").count() == 150


def test_repeated_rows_are_fitted_once(spark, monkeypatch):
    """Rows that repeat others count by their weight: one fit over the different rows, the same model as over all."""
    from pyspark.ml.classification import LogisticRegression

    from tidemark.operators import models

    sizes, fit = [], LogisticRegression._fit

    def spied(self, data):
        sizes.append(data.count())
        return fit(self, data)

    monkeypatch.setattr(LogisticRegression, "_fit", spied)
    kinds = [(float(i % 7), None if i % 5 == 0 else float(i % 3), "abc"[i % 3], int((i * 7919) % 11 < i % 7), 1.0) for i in range(105)]
    rows = spark.createDataFrame(kinds, "x double, y double, s string, label int, always double")
    many = rows.crossJoin(spark.range(40)).drop("id")
    inputs = (["x", "y", "always"], ["s"])
    b = models.Learner(*inputs).fit(many, "label")
    different = rows.distinct().count()
    assert sizes == [different] and different < 105 * 40
    got = {tuple(r)[:4]: r["p"] for r in b.predict(rows, "p").select("x", "y", "s", "label", "p").collect()}
    once = models.Learner(*inputs)
    once.bounds, n = b.bounds, 105 * 40
    data = once._prepared(many).withColumn("_y", F.col("label").cast("double"))
    plain = b.fitted.stages
    for s in plain[:-2]:
        data = s.transform(data)
    data = plain[-2].transform(data)
    scaler = models.StandardScaler(inputCol="_raw", outputCol="_z", withMean=True).fit(data)
    assert scaler.mean.toArray() == pytest.approx(plain[1].mean.toArray(), abs=1e-9) and scaler.std.toArray() == pytest.approx(plain[1].std.toArray(), abs=1e-9)
    whole = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / n, standardization=False, maxIter=100).fit(data.drop("rawPrediction", "probability", "prediction"))
    want = {tuple(r)[:4]: r["probability"][1] for r in whole.transform(data).select("x", "y", "s", "label", "probability").collect()}
    assert got == pytest.approx(want, abs=1e-4)
