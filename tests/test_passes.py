"""How often queries make their rows, what a task sorts, what a stream carries; and that none of it changes what they tell."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import floor_to, shifted
from tidemark.operators import grid, metrics, monitor, selection
from tidemark.plans import flows, queries
from tidemark.plans.bindings import observations, plan
from tidemark.sources import raw
from tidemark.streaming import live, stored

SF = "/root/testdata/sf0.001"
SCHEMA = "day int, cutoff_min int, label int, model double, base double, flag int, outcome string"


@pytest.fixture
def counted(spark):
    """300 rows, many of them equal, through a step that counts how often it makes one."""
    r = random.Random(5)
    one = lambda: (r.randrange(6), r.choice((30, 10)), r.choice((0, 1, 1, None)), r.choice((0.2, 0.5, 0.8, None)), r.choice((0.3, 0.6)), r.randrange(2), r.choice(("evaluated", "evaluated", "excluded")))
    rows = [one() for _ in range(300)]
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, SCHEMA).mapInArrow(count, SCHEMA), made


def test_pooled_summary_makes_its_rows_once(counted):
    rows, made = counted
    got = monitor.pooled(rows, "day", "cutoff_min", "label", "model", "base", 20, 5).collect()
    assert made.value == 300 and {r["cutoff_min"] for r in got} == {30, 10}


def test_performance_makes_its_rows_once(counted):
    rows, made = counted
    got = {r["cutoff_min"]: r for r in monitor.performance(rows, ["cutoff_min"], "label", "model", "base", "flag").collect()}
    assert made.value == 300
    used = rows.where("outcome = 'evaluated'").cache()
    plain = {r["cutoff_min"]: r for r in metrics.scores(used, ["cutoff_min"], "label", "model").collect()}
    rule = {r["cutoff_min"]: r for r in metrics.flag_metrics(used, ["cutoff_min"], "label", "flag").collect()}
    at = {r["cutoff_min"]: r for r in metrics.recall_at_precision(used, ["cutoff_min"], "label", "model", 0.5).collect()}
    some = metrics.collapsed(used, ["cutoff_min", "label", "model"])
    weighted = {r["cutoff_min"]: r for r in metrics.recall_at_precision(some, ["cutoff_min"], "label", "model", 0.5, F.col("_c")).collect()}
    assert set(got) == {30, 10} and at == weighted
    for c, g in got.items():
        assert g["model_n"] == plain[c]["n"]
        assert [g[f"model_{k}"] for k in ("fail_rate", "mean_p", "log_loss", "brier", "auc")] == pytest.approx([plain[c][k] for k in ("fail_rate", "mean_p", "log_loss", "brier", "auc")])
        assert [g["rule_precision"], g["rule_recall"]] == pytest.approx([rule[c]["precision"], rule[c]["recall"]])


def test_comparisons_make_their_rows_once(counted):
    rows, made = counted
    now, other = selection.Setup(groups=("a",)), selection.Setup(groups=("a", "b"))
    asked = (selection.Question("b", "add", other, now), selection.Question("b", "drop", now, other))
    got = {r["kind"]: r for r in selection.compare(rows.where("cutoff_min = 30"), asked, {now: "base", other: "model"}, "label", "day", "cutoff_min", 20, 5).collect()}
    assert made.value == 300
    plain = metrics.bootstrap_gain(rows.where("cutoff_min = 30").cache(), "day", "label", "model", "base", 20, 5).first()
    assert (got["add"]["days"], got["add"]["rows"]) == (plain["days"], plain["rows"]) == (got["drop"]["days"], got["drop"]["rows"])
    assert [got["add"][k] for k in ("gain", "low", "high", "day_share", "auc_diff")] == pytest.approx([plain[k] for k in ("log_loss_gain", "log_loss_gain_low", "log_loss_gain_high", "day_share", "auc_diff")])


def test_first_logged_in_parts(spark):
    log = spark.range(600).select((F.col("id") % 200).alias("k"), (F.col("id") * 7 % 13).alias("t"), "id")
    whole, parts = monitor.first_logged(log, ["k"], "t"), monitor.first_logged(log, ["k"], "t", 7)
    assert sorted(whole.collect()) == sorted(parts.collect()) and parts.rdd.getNumPartitions() == 7


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_logged_rows_have_as_many_parts_as_their_number_asks(spark, monkeypatch):
    monkeypatch.setattr(queries, "LOGGED_ROWS_A_TASK", 200)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert queries._logged(spark, SF).rdd.getNumPartitions() == lines // 200 + 1


def test_bodies_are_parsed_once(spark, tmp_path, capsys):
    """A step of the plan that names from_xml() parses each body, as a filter that Spark infers does."""
    body = '<timetable station="A"><s id="7-1-1"><ar pt="2401010000"/></s><s/><s id="8-1-1"><m t="c"/></s></timetable>'
    rows = [("2024-01-01T00:00:00Z", "plan", "1", "u", 200, 5, b) for b in (body, "<timetable/>", "503 <busy", None)]
    spark.createDataFrame(rows, raw.RAW_SCHEMA.removesuffix(", _bad string")).write.json(str(tmp_path / "raw"))
    got = raw.parse_responses(raw.read_raw(spark, str(tmp_path / "raw")).where("_bad IS NULL"))
    got.explain("formatted")
    steps = [step for step in capsys.readouterr().out.split("\n\n") if "from_xml(" in step.replace("Output", "Arguments").split("Arguments", 1)[0] or re.search(r"(Condition|Arguments) ?:.*size\(from_xml", step)]
    assert steps == []
    assert sorted((r["stop_id"] or "", r["event"]) for r in got.collect()) == [("", "s"), ("7-1-1", "ar"), ("8-1-1", "s")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_parts_of_a_stream_are_batches_of_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "ROWS_A_FILE", 60)
    obs, seen = observations(spark, SF), []

    def look(batch, n):
        seen.append((*batch.agg(F.min("obs"), F.max("obs"), F.count("*")).first(), batch.select(F.input_file_name()).distinct().count()))

    flows._in_parts(spark, obs, "obs", SF).writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and seen[0][1] < seen[1][0] and seen[1][1] < seen[2][0] and sum(s[2] for s in seen) == obs.count()
    assert len({s[3] for s in seen}) == 1 and seen[0][3] > 1


def test_join_of_streams_keeps_one_store_a_partition(spark, tmp_path):
    folder = str(tmp_path / "p")
    spark.range(20).select("id", F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts")).write.parquet(folder)
    p = spark.readStream.schema("id long, ts timestamp").parquet(folder)
    labels = p.select("id", F.col("ts").alias("known"), F.lit(True).alias("eligible"))
    stored.start_stored(stored.online_outcomes(p, labels, ["id"], "ts", "known", "60 minutes"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    kept = {f for f in os.listdir(tmp_path / "c" / "state" / "0" / "0") if not f.startswith((".", "_"))}
    assert not any(f.startswith(("left-", "right-")) for f in kept)
    assert spark.read.parquet(str(tmp_path / "o")).where("outcome = 'evaluated'").count() == 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_hub_state_carries_one_observation_a_key(spark, tmp_path):
    """And tells what all observations at once tell."""
    obs, p, out = observations(spark, SF), plan(spark, SF).withColumn("key", F.col("trip").cast("long")), str(tmp_path / "o")
    live.grid_state_stream(flows._in_parts(spark, obs, "obs", SF), p, out, str(tmp_path / "c"), keep="3650 days").awaitTermination()
    assert spark.read.parquet(f"{out}-carried/n=2").count() == obs.select("key").distinct().count()
    low, high = obs.agg(F.min("obs"), F.max("obs")).first()
    want = grid.hub_state(grid.events_on_grid(p, obs, shifted(floor_to(F.lit(low), 5), 5), F.lit(high)))
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.select("eva", "g", *[F.round(c, 6) for c in want.columns if c.startswith("hub_")]).collect())
    assert plain(spark.read.parquet(out)) == plain(want) != []
