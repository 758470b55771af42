"""All features of connections out of stored data: values, nulls, and that the future changes nothing; skew over text."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import features, grid, monitor, offline

T0 = datetime(2026, 9, 24, 6, 0)
OBS = "key string, obs timestamp, ct timestamp, cs string"
ROW = "row string, eva string, hub string, t_cut timestamp, planned_slack_min double, n_stations_before_a int, line_a string, key_a string, key_b string, stop_id_a string, stop_id_b string, pt_a timestamp, pt_b timestamp, pp_a string, pp_b string, segment_a string, segment_b string"
PLAN = "eva string, stop_id string, event string, trip string, key string, pt timestamp, line string, path string, first_seen timestamp"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def computed(spark, obs, rows=None):
    plan = spark.createDataFrame(
        [("1", "a", "ar", "a", "a", at(60), "L", "F|G", at(0)), ("1", "b", "dp", "b", "b", at(70), "L", None, at(0)), ("1", "b", "ar", "b", "b", at(65), "L", "G", at(45)), ("9", "f", "ar", "f", "f", at(20), "L", None, at(0))], PLAN
    )
    g = grid.events_on_grid(plan, obs)
    feeders = spark.createDataFrame([("F", "9")], "name string, eva string")
    of_events = spark.createDataFrame([("a", "d", at(1)), ("a", "d", at(31)), ("a", "q", at(30)), ("b", "d", at(2)), (None, "d", at(0))], "key string, type string, obs timestamp")
    of_stops = spark.createDataFrame([("a", "h", at(30)), ("b", "h", at(31)), ("a", "c", None)], "stop_id string, type string, obs timestamp")
    asked = rows or [("r", "1", "X", at(30), 10.0, 2, "L", "a", "b", "a", "b", at(60), at(70), "1", "1", "S-Bahn", "regional")]
    return offline.all_features(spark.createDataFrame(asked, ROW), plan, obs, of_events, of_stops, feeders, grid.hub_state(g), grid.line_state(g))


SEEN = [("a", at(10), at(62), None), ("a", at(29), at(66), None), ("b", at(14), at(70), None), ("b", at(28), at(73), None), ("f", at(25), at(24), None)]
LATER = [("a", at(31), at(99), "c"), ("b", at(31), None, "c"), ("f", at(31), at(90), None)]


def test_every_feature_of_one_connection(spark):
    r = computed(spark, spark.createDataFrame(SEEN, OBS)).first().asDict()
    assert list(r) == ["row", *features.feature_columns(list(features.GROUPS))]
    assert (r["db_delay_a_min"], r["db_delay_b_min"], r["db_slack_min"], r["b_cancel_known"]) == (6, 3, 7, False)
    assert (r["trend_a_15"], r["trend_a_30"], r["trend_b_15"], r["age_a_min"], r["age_b_min"]) == (4, 6, 3, 1, 2)
    assert [r[c] for c in offline.MESSAGES] == [1, 1, 1, 1, 0, 0]
    # the feeder's train is 4 minutes late at 30; the other train's way in was not known then
    assert (r["corridor_delay_a"], r["corridor_line_delay_a"], r["corridor_delay_b"]) == (4, 4, None)
    assert (r["hub"], r["same_platform"], r["day_type"]) == ("X", 1, "weekday")


def test_the_future_changes_no_feature(spark):
    assert computed(spark, spark.createDataFrame(SEEN + LATER, OBS)).first() == computed(spark, spark.createDataFrame(SEEN, OBS)).first()


def test_nothing_known(spark):
    row = ("n", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)
    other = ("o", "7", "Y", at(30), 4.0, 0, None, "x", "y", "x", "y", at(60), at(64), None, None, "S-Bahn", "S-Bahn")
    got = {r["row"]: r for r in computed(spark, spark.createDataFrame(SEEN, OBS), [row, other]).collect()}
    assert (got["o"]["db_slack_min"], got["o"]["trend_a_15"], got["o"]["age_a_min"], got["o"]["hub_mean_delay"], got["o"]["corridor_delay_a"]) == (4, 0, None, None, None)
    assert (got["n"]["db_slack_min"], got["n"]["n_delay_codes_a"], got["n"]["h_notice_b"]) == (None, 0, 0)
    assert computed(spark, spark.createDataFrame([], OBS)).count() == 1


def test_skew_of_text_and_differences(spark):
    live = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "y", None), (4, "z", 4.0)], "k int, s string, v double")
    off = spark.createDataFrame([(1, "x", 1.0), (2, None, 5.0), (3, "n", None), (4, None, None)], "k int, s string, v double")
    got = {r["feature"]: (r["rows"], r["equal_share"], r["mean_abs_diff"], r["mean_abs_diff_where_different"]) for r in monitor.skew(live, off, ["k"], ["s", "v"]).collect()}
    assert got == {"s": (4, 0.5, None, None), "v": (4, 0.5, 1.5, 3.0), "<row>": (4, 0.25, None, None)}
    assert monitor.skew(live.where(F.lit(False)), off, ["k"], ["s"]).count() == 0
