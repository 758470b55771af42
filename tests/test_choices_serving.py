"""Folds, choices under a rule, bundles, scoring streams and reports, against plain code and their batch forms."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bundle, folds, grid, metrics, models, monitor, profile, selection, serving
from tidemark.sources import raw
from tidemark.streaming import live, scoring

T0 = datetime(2025, 3, 3, 5, 0)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def roles(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["fold"], r["role"]), set()).add(r["day"])
    return out


def test_folds(spark):
    days = spark.createDataFrame([(d,) for d in (4, 1, 2, 3, 7, 2, None)], "day int")
    assert roles(folds.fold_table(days, "day", 2)) == {(0, "fit"): {1, 2}, (0, "evaluate"): {3}, (1, "fit"): {1, 2, 3}, (1, "evaluate"): {4}, (2, "fit"): {1, 2, 3, 4}, (2, "evaluate"): {7}}
    assert roles(folds.fold_table(days, "day", 2, 2, window=2)) == {(0, "fit"): {1, 2}, (0, "evaluate"): {3, 4}, (1, "fit"): {3, 4}, (1, "evaluate"): {7}}
    assert folds.fold_table(days, "day", 5).count() == 0
    dated = days.where("day IS NOT NULL").select(F.date_add(F.lit("2025-01-30").cast("date"), F.col("day")).alias("day"))
    assert roles(folds.fold_table(dated, "day", 4, window=3))[0, "fit"] == {date(2025, 2, 1), date(2025, 2, 2), date(2025, 2, 3)}
    assert roles(folds.leave_one_out(days, "day"))[1, "fit"] == {1, 3, 4, 7}
    blocks = roles(folds.day_blocks(days, "day", 2))
    assert blocks[0, "evaluate"] | blocks[1, "evaluate"] == {1, 2, 3, 4, 7} and not blocks[0, "evaluate"] & blocks[0, "fit"]
    assert folds.day_blocks(days.where("day = 1"), "day", 3).count() == 0


def test_locked_periods(spark):
    rows = spark.createDataFrame([(date(2025, m, 5), m) for m in range(1, 7)], "day date, x int")
    periods = [folds.Period("a", "2025-01-01", "2025-02-28"), folds.Period("b", "2025-03-01", "2025-03-31"), folds.Period("c", "2025-05-01")]
    assert {(r["day"].month, r["period"]) for r in folds.calendar(rows, "day", periods).collect()} == {(1, "a"), (2, "a"), (3, "b"), (4, "outside"), (5, "c"), (6, "c")}
    assert folds.days_of(rows, "day", periods, "a", locked=("c",)).count() == 2
    with pytest.raises(folds.LockedDays):
        folds.days_of(rows, "day", periods, "c", locked=("c",))
    assert folds.days_of(rows, "day", periods, "c", locked=("c",), allow=("c",)).count() == 2
    with pytest.raises(folds.LockedDays, match="2025-05-05"):
        folds.checked(rows, "day", periods, ("c",))
    assert folds.checked(rows.where("x < 5"), "day", periods, ("c",)).count() == 4
    with pytest.raises(ValueError):
        folds.days_of(rows, "day", periods, "nothing")


def result(subject, kind, cutoff, gain, low=0.01, share=1.0):
    return (subject, kind, cutoff, gain, low, share)


def test_verdicts(spark):
    rows = [
        result("noise", "noise", 30, -0.004), result("noise", "noise", 60, 0.003),
        result("good", "add", 30, 0.02), result("good", "add", 60, -0.005),  # within twice the noise at 60
        result("small", "add", 30, 0.007), result("unsure", "add", 30, 0.02, low=-0.001), result("seldom", "drop", 30, 0.02, share=0.4),
        result("harmful", "drop", 30, 0.03), result("harmful", "drop", 60, -0.0061), result("absent", "restricted", 60, 0.5),
    ]
    table = spark.createDataFrame(rows, "subject string, kind string, cutoff int, gain double, low double, day_share double")
    judged = selection.verdicts(table)
    got = {r["subject"]: r["failed"] for r in judged.collect()}
    assert got == {"good": [], "small": ["gain"], "unsure": ["interval"], "seldom": ["days"], "harmful": ["other_cutoff"], "absent": ["not_evaluated"]}
    assert {round(r["least"], 6) for r in judged.collect()} == {0.008} and selection.winner(judged) == "good"
    assert selection.winner(selection.verdicts(table.where("subject = 'small'"), selection.Bar(gain=0.5))) is None


def signal_rows(spark, days=6, n=120):
    import random

    rng = random.Random(8)
    rows = []
    for day in range(days):
        for k in range(n):
            x, z = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((day * n + k, day, 30 if k % 2 else 10, x, z, rng.random(), int(rng.random() < 1 / (1 + 2.718 ** -(2 * x + 2 * z)))))
    return spark.createDataFrame(rows, "id int, day int, cutoff int, x double, z double, noise double, y int").cache()


GROUPS = {"base": ["x"], "useful": ["z"], "useless": ["noise"], "twin": ["twin"], "late": ["z"]}


def by_groups(setup):
    return models.Learner([c for g in setup.groups for c in GROUPS[g]], seed=setup.seed)


def test_questions_about_groups_and_their_fits(spark):
    rows = signal_rows(spark)
    now = selection.Setup(groups=("base", "useless"))
    asked = selection.about_groups(now, {"useless": None, "useful": None, "late": 2})
    assert [(q.subject, q.kind) for q in asked] == [("useless", "drop"), ("useful", "add"), ("late", "restricted")]
    columns = selection.columns_of(asked)
    assert len(columns) == 5  # the setup in use serves two questions
    scored = selection.predict_setups(rows, ["id"], "y", "day", columns, by_groups, 3, 3).cache()
    assert scored.count() == rows.count() and scored.where(F.col(columns[now]).isNull()).count() == 360
    assert {r["day"] for r in scored.where(F.col(columns[asked[2].setup]).isNotNull()).select("day").distinct().collect()} == {5}
    judged = {r["subject"]: r["passes"] for r in selection.verdicts(selection.compare(scored, asked, columns, "y", "day", "cutoff", draws=50, auc_draws=5)).collect()}
    assert judged == {"useful": True, "useless": False, "late": True}


def test_changes_are_taken_together_or_the_best_alone(spark):
    rows = signal_rows(spark).withColumn("twin", F.col("z"))
    now = selection.Setup(groups=("useless",))
    choice, _ = selection.choose_groups(rows, ["id"], "y", "day", "cutoff", now, {"base": None, "useful": None}, by_groups, 3, 3, draws=50, auc_draws=2)
    assert choice.groups == ("useless", "base", "useful") and choice.together < choice.best_alone
    one, _ = selection.choose_groups(rows, ["id"], "y", "day", "cutoff", selection.Setup(groups=("base",)), {"useful": None, "late": 2}, by_groups, 3, 3, draws=50, auc_draws=2)
    assert one.groups == ("base", "useful", "late") and one.together is None

    class Spoiled(models.Learner):
        """A learner that loses with both of two good groups at once."""

        def predict(self, rows, out="p"):
            scored = super().predict(rows, out)
            return scored.withColumn(out, 1 - F.col(out)) if {"z", "twin"} <= set(self.numeric) else scored

    make = lambda s: Spoiled([c for g in s.groups for c in GROUPS[g]], seed=s.seed)
    lost, _ = selection.choose_groups(rows, ["id"], "y", "day", "cutoff", selection.Setup(groups=("base",)), {"useful": None, "twin": None}, make, 3, 3, draws=50, auc_draws=2)
    assert lost.together > lost.best_alone and lost.groups == ("base", lost.best)


def test_questions_about_settings():
    now = selection.Setup(settings=(("a", 1), ("b", 2)))
    asked = selection.about_settings(now, {"a": [1, 5]}, (0, 7))
    assert [q.subject for q in asked] == ["window=0,a=5", "window=7,a=1", "window=7,a=5"] and all(q.against == now for q in asked)
    assert asked[2].setup == selection.Setup(settings=(("a", 5), ("b", 2)), window=7) and selection.noise_floor(now).setup.seed == 1


def test_narrowing_finds_the_grid_s_winner_with_fewer_fits(spark):
    rows = signal_rows(spark, 10, 100)
    now = selection.Setup(settings=(("penalty", 0.001),))
    asked = selection.about_settings(now, {"penalty": (1e-7, 1e-5, 0.001, 1.0)}, (0,))
    make = lambda s: models.Learner(["x", "z"], seed=s.seed, **dict(s.settings))
    bar = selection.Bar(days=0.5)
    columns = selection.columns_of([selection.noise_floor(now), *asked])
    whole = selection.predict_setups(rows, ["id"], "y", "day", columns, make, 2, 2)
    full = selection.verdicts(selection.compare(whole, [selection.noise_floor(now), *asked], columns, "y", "day", "cutoff", 100, 2), bar)
    judged, fits = selection.narrow_settings(rows, ["id"], "y", "day", "cutoff", now, asked, make, 2, 2, bar, 100)
    assert selection.winner(full) == selection.winner(judged) == "window=0,penalty=1.0"
    assert fits < 4 * len(columns) and judged.count() < len(asked)


def test_logistic_expression_equals_the_pipeline(spark):
    rows = signal_rows(spark).withColumn("c", F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), (F.col("id") % 3).cast("string")))).withColumn("gap", F.when(F.col("id") % 4 > 0, F.col("noise")))
    model = models.Learner(["x", "gap"], ["c"]).fit(rows.where("id % 3 <> 1"), "y")  # k1 is unseen
    own = {r["id"]: r["p"] for r in model.predict(rows).collect()}
    there = model.fitted.transform(model._prepared(rows)).select("id", "probability").collect()
    assert all(abs(own[r["id"]] - r["probability"][1]) < 1e-12 for r in there)


def test_drop_one_group_and_calibration(spark):
    rows = signal_rows(spark, 4)
    out = models.drop_one_group(rows, "y", "day", folds.leave_one_out(rows.where("day < 2"), "day"), {"g": ["x"], "h": ["z"]}, lambda cols: models.Learner(cols))
    assert out.count() == 240 and {"all", "without g", "without h"} <= set(out.columns)
    assert metrics.scores(out, [], "y", "all").first()["auc"] > metrics.scores(out, [], "y", "without g").first()["auc"]
    for method in ("platt", "isotonic", "none"):
        model = models.CalibratedModel(lambda: models.Learner(["x", "z"]), "day", method, 2).fit(rows, "y")
        assert model.predict(rows).where("p BETWEEN 0 AND 1").count() == rows.count()
    one_day = models.CalibratedModel(lambda: models.Learner(["x"]), "day").fit(rows.where("day = 0"), "y")
    assert one_day.predict(rows.limit(3)).where("p IS NULL").count() == 0


def test_bundle_round_trip(spark, tmp_path):
    rows = signal_rows(spark, 4).withColumn("day", F.date_add(F.lit("2025-01-01").cast("date"), F.col("day"))).withColumn("k", F.when(F.col("x") > 0, "up"))
    made = bundle.fit_bundle(rows, "y", "day", "cutoff", {"m": models.Learner(["x", "z"], ["k"]), "b": models.Learner(["x"], kind="gbt", rounds=3)}, {"setting": "1"}, {"b": 2})
    path = str(tmp_path / "bundle")
    bundle.write_bundle(made, spark, path)
    again = bundle.read_bundle(spark, path, {"setting": "1"})
    assert again.card == made.card and again.card["m.days"] == "4" and again.card["b.first_day"] == "2025-01-03" and list(again.models) == ["m", "b"]
    for name in ("m", "b"):
        one, two = ({r["id"]: r["p"] for r in m.models[name].predict(rows).collect()} for m in (made, again))
        assert one == two
    assert bundle.inputs(again) == ["x", "z", "k"] and {r["input"] for r in again.profile.collect()} == {"x", "z", "k"}
    rates = {r["cutoff"]: r for r in bundle.live_rates(again, rows.where("y = 1"), "y", "cutoff").collect()}
    assert rates[30]["fail_rate"] == 1 and rates[30]["difference"] == pytest.approx(1 - rates[30]["fit_rate"])
    with pytest.raises(bundle.CardMismatch, match="setting"):
        bundle.read_bundle(spark, path, {"setting": "2"})


PLAN = "eva string, stop_id string, event string, trip string, key long, pt timestamp, pp string, line string, path string, wings string, tra string, cat string, num string, first_seen timestamp"


def small_world(spark):
    event = lambda stop, kind, trip, m, path, line=None: ("1", stop, kind, trip, int(trip), at(m), "1", line, path, None, None, "RE", trip, at(-600))
    plan = spark.createDataFrame([event("1-1", "ar", "1", 40, "P", "L"), event("2-1", "dp", "2", 50, "X"), event("3-1", "dp", "3", 55, "Y"), event("4-1", "ar", "4", 64, "Q"), event("5-1", "dp", "5", 75, "Z"), event("6-1", "ar", "6", 200, "P"), event("7-1", "ar", "7", -10, "P", "L")], PLAN)
    hubs = spark.createDataFrame([("1", "Hub")], "eva string, hub string")
    obs = spark.createDataFrame([(1, at(-30), at(42), None, "1"), (7, at(-20), at(-4), None, "1"), (1, at(0), at(47), None, "1"), (4, at(3), None, "c", "1"), (3, at(4), None, "c", "1"), (2, at(4), at(51), None, "1")], "key long, obs timestamp, ct timestamp, cs string, eva string")
    train = signal_rows(spark).select((F.col("x") * 5 + 5).alias("db_slack_min"), F.col("y"), "day", F.lit(30).alias("cutoff")).withColumn("day", F.date_add(F.lit("2025-01-01").cast("date"), "day"))
    b = bundle.fit_bundle(train, "y", "day", "cutoff", {"p_model": models.Learner(["db_slack_min"]), "p_base": models.Learner(["db_slack_min"])}, {})
    return plan, hubs, obs, b


def test_scoring_stream_equals_batch(spark, tmp_path):
    plan, hubs, obs, b = small_world(spark)
    folder = str(tmp_path / "in")
    for low, high in ((-60, -1), (0, 3), (4, 9)):
        obs.where((F.col("obs") >= F.lit(at(low))) & (F.col("obs") <= F.lit(at(high)))).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "live")
    scoring.score_stream(stream, plan, hubs, b, out, str(tmp_path / "c")).awaitTermination()
    scores = spark.read.parquet(f"{out}/scores").cache()
    last = {(r["stop_id_a"], r["stop_id_b"]): r for r in serving.latest_scores(scores).collect()}
    now = F.lit(at(4))
    states = scoring.states_at(obs, now)
    batch = {(r["stop_id_a"], r["stop_id_b"]): r for r in scoring.score_now(plan, hubs, states, obs.groupBy("eva").agg(F.max("obs").alias("last")), b, now).collect()}
    assert last.keys() == batch.keys() == {("1-1", "2-1"), ("1-1", "3-1"), ("4-1", "5-1")}
    for k, r in last.items():
        assert all(r[c] == batch[k][c] for c in batch[k].asDict() if c != "n"), k
    x = last["1-1", "2-1"]
    assert (x["db_slack_min"], x["db_delay_a_min"], x["status"], x["minutes_to_arrival"]) == (4.0, 7.0, "ok", 36.0) and 0 < x["p_model"] < 1
    assert x["hub_mean_delay"] == 6.0 and x["line_recent_delay_a"] == 6.0  # of what is near now, train 7 alone ran
    assert last["1-1", "3-1"]["b_cancel_known"] == 1 and last["4-1", "5-1"]["status"] == "a_cancelled" and last["4-1", "5-1"]["p_model"] is None
    silent = scoring.score_now(plan, hubs, states, obs.groupBy("eva").agg(F.lit(at(-60)).alias("last")), b, now).collect()
    assert {r["status"] for r in silent} == {"collector_gap", "a_cancelled"}
    assert len(list((tmp_path / "live" / "states").glob("n=*"))) == 2  # older ones are removed

    shown = serving.connections(scores, now, hub="Hub", include_unscored=True).collect()
    assert len(shown) == 3 and {r["train_a"] for r in shown} == {"REL", "RE 4"} and {r["arrives"] for r in shown} == {"2025-03-03T06:40:00", "2025-03-03T07:04:00"}
    assert serving.connections(scores, now).count() == 2 and serving.connections(scores, now, within_min=10).count() == 0 and serving.connections(scores, now, hub="x").count() == 0
    assert serving.connections(scores, now, min_risk=1.1, include_unscored=True).count() == 1
    assert serving.connection(scores, now, "1-1", "2-1").first()["cutoff_min"] == 30 and serving.connection(scores, now, "1-1", "x").count() == 0


def test_hub_state_stream_equals_batch(spark, tmp_path):
    plan, _, obs, _ = small_world(spark)
    folder = str(tmp_path / "in")
    for low, high in ((-60, -1), (0, 9)):
        obs.where((F.col("obs") >= F.lit(at(low))) & (F.col("obs") <= F.lit(at(high)))).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "grid")
    live.grid_state_stream(stream, plan, out, str(tmp_path / "c")).awaitTermination()
    key = lambda df: sorted((r["eva"], r["g"], r["hub_share_cancel"], r["hub_mean_delay"]) for r in df.collect())
    want = grid.hub_state(grid.events_on_grid(plan, obs, F.lit(at(-25)), F.lit(at(4))))
    assert key(spark.read.parquet(out)) == key(want) and want.count() > 3


def test_reports(spark):
    reports = spark.createDataFrame([(1, 10), (2, 20)], "day int, logged int")
    drift = spark.createDataFrame([(1, "x", 0.1, "ok"), (1, "y", 0.3, "ok"), (1, "hour", 0.9, "ok"), (1, "z", 0.8, "skipped"), (2, "x", None, "too_few_rows")], "day int, input string, psi double, status string")
    skews = spark.createDataFrame([(1, 10, 1.0), (1, 30, 0.5), (2, 0, 0.1)], "day int, rows int, identical_share double")
    got = {r["day"]: r for r in monitor.summary_by_day(reports, drift, skews, ["hour"]).collect()}
    assert (got[1]["max_psi_input"], got[1]["max_psi"], got[1]["identical_share"]) == ("y", 0.3, 0.625)
    assert (got[2]["max_psi_input"], got[2]["identical_share"]) == (None, None)
    rows = signal_rows(spark).select("day", "cutoff", "y", (F.col("y") * 0.5 + 0.2).alias("m"), F.lit(0.4).alias("b")).withColumn("outcome", F.when(F.col("day") < 4, "evaluated").otherwise("excluded"))
    pooled = {r["cutoff"]: r for r in monitor.pooled(rows, "day", "cutoff", "y", "m", "b", 50, 5).collect()}
    assert pooled[30]["days"] == 4 and pooled[30]["rows"] == 240 and pooled[30]["log_loss_gain_low"] > 0 and pooled[30]["auc_diff"] == 0.5


def test_skew_found_by_recomputing(spark):
    obs = spark.createDataFrame([(1, at(0), at(12), None), (2, at(1), at(25), "c"), (1, at(9), at(99), None)], "key long, obs timestamp, ct timestamp, cs string")
    log = spark.createDataFrame([("a", "b", at(5), 1, 2, at(10), at(20), 13.0)], "stop_id_a string, stop_id_b string, scored_at timestamp, key_a long, key_b long, pt_a timestamp, pt_b timestamp, db_slack_min double")
    r = monitor.recomputed(log, obs).first()
    assert (r["db_delay_a_min"], r["db_delay_b_min"], r["db_slack_min"], r["b_cancel_known"]) == (2, 5, 13, 1)


def test_close_names_within_two_edits(spark):
    known = ["Köln Hbf", "Koeln Hbf", "Bonn Hbf", "Essen", "Esen", "Ulm", "U"]
    asked = ["Koln Hbf", "Essn", "Olm", "Nowhere at all", "Bonn Hbf", ""]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for a in set(asked) - set(known):
        near = sorted((edits(a, b), b) for b in known if edits(a, b) <= 2)[:3]
        want |= {(a, b, d) for d, b in near} or {(a, None, None)}
    got = profile.closest_names(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame([(k,) for k in known], "name string"))
    assert {(r["name"], r["close"], r["distance"]) for r in got.collect()} == want


def test_censuses(spark, tmp_path):
    body = """<h1 id='x'>t</h1><a data-id="1" href = "u">b</a><h2 id="x"/><A HREF='v w'>"""
    got = {(r["element"], r["attribute"], r["value"]) for r in raw.element_census(spark.createDataFrame([(body,), (None,)], "body string")).collect()}
    assert got == {("h1", "id", "x"), ("a", "data-id", "1"), ("a", "href", "u"), ("h2", "id", "x"), ("A", "HREF", "v w")}
    for month, schema in (("2025-01", "a int"), ("2025-02", "a int"), ("2025-03", "a string")):
        spark.createDataFrame([(None,)] * 3, schema).coalesce(1).write.parquet(str(tmp_path / "t" / month))
    census = {r["signature"]: r for r in raw.schema_census(spark, [str(tmp_path / "t")]).collect()}
    assert (census["a:int32"]["files"], census["a:int32"]["rows"], census["a:int32"]["first_month"], census["a:int32"]["last_month"]) == (2, 6, "2025-01", "2025-02") and census["a:string"]["files"] == 1
    assert raw.schema_census(spark, []).count() == 0


def test_days_with_records(spark, tmp_path):
    path = str(tmp_path / "days")
    raw.replace_days(spark.createDataFrame([("d1", 1, 5), ("d2", 2, 5)], "service_day string, x int, y int"), path, meta={"v": "1"})
    raw.replace_days(spark.createDataFrame([("d2", 3, 5), ("d2", 4, 5)], "service_day string, x int, y int"), path, meta={"v": "2"})
    meta = {r["service_day"]: (r["rows"], r["facts"]["v"]) for r in spark.read.parquet(f"{path}_meta").collect()}
    assert meta == {"d1": (1, "1"), "d2": (2, "2")}
    some = raw.read_days(spark, path, ["x"], ["d2"])
    assert sorted(r["x"] for r in some.collect()) == [3, 4] and some.columns == ["x", "service_day"]
    assert "PartitionFilters: [" in some._jdf.queryExecution().toString() and "y:int" not in some._jdf.queryExecution().toString().split("ReadSchema")[-1]
