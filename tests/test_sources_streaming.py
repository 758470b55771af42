"""Raw responses to parsed tables, batch and stream; streams equal their batch forms."""

import gzip
import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import last_state
from tidemark.sources import raw
from tidemark.streaming import live, stored

PLAN = """<timetable station="Hub"><s id="-40-2503110455-2"><tl f="F" t="p" o="Y" c="IC" n="77"/>
<ar pt="2503110640" pp="9" l="IC7" ppth="M|N"/><dp pt="2503110648" pp="9" l="IC7" ppth="O"/></s>
<s id="31-2503110600-4"><dp pt="2503110705" tra="8-2503110001-3"/></s></timetable>"""
CHANGE = """<timetable station="Hub"><s id="6-2503110500-1"><m t="u" c="3"/><ar ct="2503110651"><m t="d" c="12"/><m t="r"/></ar><dp cs="c" clt="2503110630"/></s>
<s id="7-2503110500-1"><m t="x"/></s></timetable>"""


@pytest.fixture
def raw_folder(tmp_path):
    folder = tmp_path / "raw" / "source=plan" / "date=2025-03-11" / "hour=05"
    folder.mkdir(parents=True)
    row = lambda body, t="2025-03-11T05:00:00Z", source="plan": json.dumps(dict(collected_at=t, source=source, eva="800", url="u", status=200, duration_ms=5, body=body))
    lines = [row(PLAN), row(CHANGE, "2025-03-11T05:03:00Z", "fchg"), row("no xml <"), row(""), "{broken"]
    with gzip.open(folder / "part.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    (folder / "other.json.gz").write_bytes(gzip.compress(row(PLAN, "2025-03-12T05:00:00Z").encode()))
    return str(tmp_path / "raw")


def test_parse(spark, raw_folder):
    rows = raw.parse_responses(raw.read_raw(spark, raw_folder)).collect()
    assert len(rows) == 3 + 3 + 3
    by = {(r["stop_id"], r["event"], str(r["collected_at"])[:10]): r for r in rows}
    a = by["-40-2503110455-2", "ar", "2025-03-11"]
    assert (a["trip_key"], a["tl_category"], a["line"], a["ppth"], a["pt"], a["station_name"]) == ("-40-2503110455", "IC", "IC7", "M|N", datetime(2025, 3, 11, 5, 40), "Hub")
    b = by["6-2503110500-1", "ar", "2025-03-11"]
    assert (b["event_msgs"], b["stop_msgs"], b["ct"], b["pt"]) == ("d:12|r:", "u:3", datetime(2025, 3, 11, 5, 51), None)
    assert by["6-2503110500-1", "dp", "2025-03-11"]["cs"] == "c" and by["31-2503110600-4", "dp", "2025-03-11"]["tra"] == "8-2503110001-3"
    assert by["7-2503110500-1", "s", "2025-03-11"]["stop_msgs"] == "x:"
    errors = raw.parse_errors(raw.read_raw(spark, raw_folder)).first()
    assert (errors["responses"], errors["bad_lines"]) == (6, 1) and errors["parse_errors"] >= 1


def test_rebuild_and_pruned_read(spark, raw_folder, tmp_path):
    out = str(tmp_path / "parsed")
    counts = raw.rebuild_parsed(spark, raw_folder, out).first()
    assert (counts["responses"], counts["rows"], counts["bad_lines"]) == (6, 9, 1)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        raw.rebuild_parsed(spark, raw_folder, out)
    assert raw.rebuild_parsed(spark, raw_folder, out, replace=True).first()["rows"] == 9
    day = raw.read_parsed(spark, out, ["2025-03-12"])
    assert day.count() == 3 and "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().toString()
    extra = spark.createDataFrame([("x", 1)], "stop_id string, parser_version int").withColumn("parser_version", F.col("parser_version").cast("smallint"))
    assert raw.read_parsed(spark, out, extra=extra).count() == 10
    assert raw.check_version(day).count() == 3
    with pytest.raises(raw.OldParser):
        raw.check_version(day.withColumn("parser_version", F.lit(None).cast("smallint")))
    status = {(r["source"], r["eva"]): r for r in raw.collector_status(raw.read_parsed(spark, out)).collect()}
    assert status["fchg", "800"]["cancelled"] == 1 and status["fchg", "800"]["with_ct"] == 1
    census = {(r["element"], r["attribute"], r["value"]): r["n"] for r in raw.element_census(raw.read_raw(spark, raw_folder)).collect()}
    assert census["tl", "c", "IC"] == 2 and census["m", "t", "d"] == 1
    assert raw.schema_census(spark, [out]).agg(F.sum("rows")).first()[0] == 9
    parsed = raw.read_parsed(spark, out)
    w = raw.load_window(parsed, F.lit(datetime(2025, 3, 11, 4, 45)), F.lit(datetime(2025, 3, 11, 9)), ["800"])
    assert {(r["stop_id"], r["event"], r["first_seen"]) for r in w.plan.collect()} >= {("-40-2503110455-2", "dp", datetime(2025, 3, 11, 5)), ("31-2503110600-4", "dp", datetime(2025, 3, 11, 5))}
    assert w.span.first()["last"] == datetime(2025, 3, 11, 5, 3)
    assert "PartitionFilters: [isnotnull(date" in w.plan._jdf.queryExecution().toString()


def parsed_row(minute, source="plan", eva="800", stop="1-2503110500-1", event="ar", version=1, **columns):
    at = datetime(2025, 3, 11, 8) + timedelta(minutes=minute)
    return {"collected_at": at, "source": source, "eva": eva, "stop_id": stop, "event": event, "trip_key": stop[:-2], "parser_version": version, "date": at.date(), **columns}


WINDOW = "collected_at timestamp, source string, eva string, stop_id string, event string, trip_key string, parser_version smallint, date date, pt timestamp, pt_raw string, pp string, line string, fb string, ppth string, wings string, tra string, tl_category string, tl_number string, ct timestamp, ct_raw string, cs string"


def test_window_keeps_latest_known_values_and_all_polls(spark):
    nine, three = datetime(2025, 3, 11, 9), datetime(2025, 3, 11, 15)
    rows = [
        parsed_row(-90, pt=nine, line="before"),  # collected before the window
        parsed_row(0, pt=nine, line="L1", pp="4", tl_category="RE"),
        parsed_row(5, pt=three, pp=None),  # planned anew, out of the window, without line
        parsed_row(6, pt=None, line="L9"),  # no plan
        parsed_row(7, pt=nine, stop="2-2503110500-1", fb="FB", line=None),
        parsed_row(8, pt=nine, stop="2-2503110500-1", eva="801", line="other hub"),
        parsed_row(9, event="s", pt=nine),
        parsed_row(10, "fchg", ct=nine), parsed_row(11, "rchg", cs="c"), parsed_row(12, "fchg"), parsed_row(13, "fchg", event="s", cs="c"),
        parsed_row(55, "fchg", eva="801"),
        parsed_row(60, "rchg", cs="p"), parsed_row(61, "rchg", cs="late"),
    ]
    parsed = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in WINDOW.split(", ")) for r in rows], WINDOW)
    ends = F.lit(datetime(2025, 3, 11, 8)), F.lit(datetime(2025, 3, 11, 9))
    w = raw.load_window(parsed, *ends, ["800"])
    plan = {r["stop_id"]: r for r in w.plan.collect()}
    first = plan["1-2503110500-1"]
    assert (first["pt"], first["line"], first["pp"], first["cat"], first["first_seen"]) == (three, "L1", "4", "RE", datetime(2025, 3, 11, 8))
    assert set(plan) == {"1-2503110500-1", "2-2503110500-1"} and plan["2-2503110500-1"]["line"] == "FB"
    assert {(r["obs"].hour, r["obs"].minute, r["cs"]) for r in w.obs.collect()} == {(8, 10, None), (8, 11, "c"), (9, 0, "p")}
    assert w.polls.count() == 10  # every time at which the station was heard of
    assert tuple(w.span.first()) == (datetime(2025, 3, 11, 8), datetime(2025, 3, 11, 9))  # of all stations
    extra = spark.createDataFrame([tuple(parsed_row(20, "fchg", stop="9-2503110500-1", cs="c").get(c.split()[0]) for c in WINDOW.split(", "))], WINDOW)
    assert raw.load_window(parsed, *ends, ["800"], extra).obs.count() == 4
    with pytest.raises(raw.OldParser):
        raw.load_window(parsed, *ends, ["800"], least=2)
    with pytest.raises(ValueError, match="no parsed row"):
        raw.load_window(parsed, F.lit(datetime(2026, 1, 1)), F.lit(datetime(2026, 1, 2)))


def test_days_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "days")
    raw.replace_days(spark.createDataFrame([("d1", 1), ("d2", 2)], "service_day string, x int"), path)
    raw.replace_days(spark.createDataFrame([("d2", 3)], "service_day string, x int"), path)
    assert sorted((r["service_day"], r["x"]) for r in spark.read.parquet(path).collect()) == [("d1", 1), ("d2", 3)]


def test_streamed_parse_equals_batch(spark, raw_folder, tmp_path):
    out = str(tmp_path / "streamed")
    live.parse_stream(raw.read_raw(spark, raw_folder, stream=True), out, str(tmp_path / "c1")).awaitTermination()
    batch = raw.parse_responses(raw.read_raw(spark, raw_folder).where("_bad IS NULL"))
    key = lambda df: sorted((r["stop_id"], r["event"], r["pt_raw"] or "", r["source"]) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(batch)


T0 = datetime(2026, 1, 1)


def chunks(spark, tmp_path, parts, schema):
    folder = str(tmp_path / "in")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_state_stream_equals_batch(spark, tmp_path):
    schema = "k string, t timestamp, v int"
    parts = [[("a", T0, 1), ("b", T0 + timedelta(minutes=9), 2)], [("a", T0 + timedelta(minutes=1), None), ("b", T0, 7)], [("c", T0, 5)]]
    rows = chunks(spark, tmp_path, parts, schema)
    out = str(tmp_path / "state")
    live.state_stream(rows, out, str(tmp_path / "c2"), ["k"], "t", ["v"]).awaitTermination()
    want = last_state(spark.createDataFrame([r for p in parts for r in p], schema), ["k"], "t", ["v"])
    got = spark.read.parquet(f"{out}/n=2")
    assert len(list((tmp_path / "state").glob("n=*"))) == 2  # older snapshots are removed
    live.state_stream(chunks(spark, tmp_path, [], schema), str(tmp_path / "kept"), str(tmp_path / "c9"), ["k"], "t", ["v"], keep="5 minutes").awaitTermination()
    assert {r["k"] for r in spark.read.parquet(str(tmp_path / "kept" / "n=2")).collect()} == {"b"}
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_log_once_and_late_rows(spark, tmp_path):
    m = timedelta(minutes=1)
    schema = "k string, t timestamp, mark timestamp"
    parts = [[("a", T0 - m, T0), ("b", T0, T0 - 6 * m)], [("a", T0 + m, T0), ("a", T0 + m, T0)], [("a", T0 + 2 * m, T0), ("c", T0 + 4 * m, T0)]]
    rows = chunks(spark, tmp_path, parts, schema)
    out = str(tmp_path / "log")
    live.run_to(live.log_once(rows, ["k"], "t", "mark"), out, str(tmp_path / "c3")).awaitTermination()
    got = sorted((r["k"]) for r in spark.read.schema(schema).parquet(out).collect())
    assert got == ["a", "c"]


def test_grid_counts_stream(spark, tmp_path):
    schema = "eva string, t timestamp, v double"
    parts = [[("x", T0 + timedelta(minutes=i), float(i)) for i in range(8)], [("x", T0 + timedelta(hours=2), 0.0)], [("x", T0 + timedelta(hours=4), 0.0)]]
    rows = chunks(spark, tmp_path, parts, schema)
    out = str(tmp_path / "grid")
    live.run_to(live.grid_counts(rows, "t", ["eva"], F.col("v")), out, str(tmp_path / "c4")).awaitTermination()
    got = {r["g"]: (r["n"], r["mean"]) for r in spark.read.parquet(out).collect()}
    assert got[T0] == (5, 2.0) and got[T0 + timedelta(minutes=5)] == (3, 6.0)


def test_upcoming_and_status(spark):
    ages = live.age_status(spark.createDataFrame([("x", T0), ("y", T0 + timedelta(minutes=50)), ("z", None)], "eva string, t timestamp"), "eva", "t", F.lit(T0 + timedelta(minutes=57)))
    assert {r["eva"]: r["status"] for r in ages.collect()} == {"x": "error", "y": "degraded", "z": "error"}
    assert tuple(live.overall_status(ages).first()) == (420.0, "error") and live.overall_status(ages.limit(0)).first()["status"] == "error"
    pairs = spark.createDataFrame([(i, T0 + timedelta(minutes=i)) for i in (1, 2, 65, 66)], "i int, pt_a timestamp")
    assert sorted(r["i"] for r in live.upcoming(pairs, F.lit(T0)).collect()) == [2, 65]
    asked = spark.createDataFrame([("x", T0 + timedelta(minutes=45), None, None), ("x", T0 + timedelta(minutes=46), None, None), ("x", T0, True, None), ("x", T0, False, True)], "eva string, t timestamp, a_cancelled boolean, ambiguous boolean")
    got = [r["status"] for r in live.input_status(asked, spark.createDataFrame([("x", T0)], "eva string, p timestamp"), "eva", "t", "p").orderBy("t", "a_cancelled").collect()]
    assert sorted(got) == ["a_cancelled", "collector_gap", "dst_ambiguous", "ok"]


def test_stored_states_equal_batch_and_hold_only_changes(spark, tmp_path):
    schema = "k string, t timestamp, v int, at timestamp"
    parts = [[(f"k{i}", T0, i, T0) for i in range(40)], [("k1", T0 + timedelta(minutes=1), None, None), ("k2", T0 - timedelta(minutes=5), 9, T0), ("k3", T0, 70, None), (None, T0, 1, T0)], [("new", T0, 5, T0), ("k3", None, 8, T0)]]
    rows = chunks(spark, tmp_path, parts[:2], schema)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    live_states = lambda r: stored.last_states(r, ["k"], "t", ["v", "at"], "2 hours")
    stored.start_stored(live_states(rows), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 43  # 40, then the three that changed
    chunks(spark, tmp_path, parts[2:], schema)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stored.start_stored(live_states(rows), out, checkpoint).awaitTermination()  # goes on after a restart
    told = spark.read.parquet(out)
    assert told.count() == 44
    want = last_state(spark.createDataFrame([r for p in parts for r in p], schema).where("t IS NOT NULL"), ["k"], "t", ["v", "at"])
    got = stored.read_states(spark, out, ["k"], "t", ["v", "at"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stored_states_are_forgotten(spark, tmp_path):
    schema = "k string, t timestamp, v int"
    parts = [[("old", T0, 1), ("kept", T0, 2)], [("kept", T0 + timedelta(hours=5), 3)], [("next", T0 + timedelta(hours=5), 4)], [("last", T0 + timedelta(hours=5), 5)]]
    out = str(tmp_path / "out")
    stored.start_stored(stored.last_states(chunks(spark, tmp_path, parts, schema), ["k"], "t", ["v"], "1 hour"), out, str(tmp_path / "c")).awaitTermination()
    assert {r["k"] for r in stored.read_states(spark, out, ["k"], "t", ["v"]).collect()} == {"kept", "next", "last"}
    assert [r["k"] for r in spark.read.parquet(out).where("gone").collect()] == ["old"]


def test_silence_changes_the_age_status(spark, tmp_path):
    schema = "eva string, t timestamp"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    now = spark.range(1).select(F.current_timestamp().alias("t")).select(F.explode(F.array(F.lit("fresh"), F.lit("silent"))).alias("eva"), "t").unionByName(spark.createDataFrame([("dead", T0 - timedelta(days=4000)), (None, T0)], schema))
    now.coalesce(1).write.parquet(folder)
    query = stored.start_stored(stored.age_statuses(spark.readStream.schema(schema).parquet(folder), "eva", "t", 15, 25), out, str(tmp_path / "c"), every="1 second")
    try:
        deadline = time.time() + 120
        told = {}
        while time.time() < deadline and told.get("silent") != ["ok", "degraded", "error"]:
            time.sleep(2)
            if query.lastProgress and list((tmp_path / "out").glob("*.parquet")):
                told = {}
                for r in spark.read.schema("eva string, status string, at_ms long").parquet(out).orderBy("at_ms").collect():
                    told.setdefault(r["eva"], []).append(r["status"])
        assert told["dead"] == ["error"] and told["silent"] == ["ok", "degraded", "error"] == told["fresh"]  # without any new row
    finally:
        query.stop()


def test_online_outcomes_equal_the_batch_join(spark, tmp_path):
    m = lambda x: T0 + timedelta(minutes=x)
    told = [[(1, m(0)), (2, m(0)), (3, m(5))], [(4, m(100)), (5, m(101))], [(-1, m(10_000))]]
    made = [[(1, m(10), True), (2, m(70), True)], [(4, m(110), False), (5, m(102), None), (6, m(103), True)], [(-1, m(10_000), True)]]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    p, labels = chunks(spark, tmp_path / "a", told, "id int, ts timestamp"), chunks(spark, tmp_path / "b", made, "id int, known timestamp, eligible boolean")
    out = str(tmp_path / "out")
    stored.start_stored(stored.online_outcomes(p, labels, ["id"], "ts", "known", "60 minutes", "30 minutes"), out, str(tmp_path / "c")).awaitTermination()
    got = {r["id"]: r["outcome"] for r in spark.read.parquet(out).collect()}
    assert {k: v for k, v in got.items() if k > 0} == {1: "evaluated", 2: "not_a_candidate", 3: "not_a_candidate", 4: "excluded", 5: "excluded"}  # 2's label is late
