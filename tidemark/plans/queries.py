"""The registered queries: each binds operators to the driver's tables and returns rounded, named columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import day_start, is_ambiguous, minutes, raw_to_utc, service_day, shifted
from ..functions.trains import bucket, display_name, nearest_cutoff, path, segment, trip_key
from ..operators import asof, drift, features, folds, grid, labels, metrics, models, monitor, pairs, profile, quantiles
from ..sources import raw
from ..sources.scratch import save
from ..streaming import live
from .bindings import CUTOFFS, events, hubs, observations, plan, predictions, span, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c))


# ---- what was known at a time


def _views_at_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    views = events(spark, sf).where("event_type = 'view'").select("event_id", F.col("user_id").alias("key"), "ts", "value", F.explode(F.array(*[F.lit(c) for c in CUTOFFS])).alias("cutoff_min"))
    asked = views.withColumn("t_cut", shifted(F.col("ts"), -F.col("cutoff_min")))
    return asof.asof_join(asked, observations(spark, sf), ["key"], "t_cut", "obs", ["ct", "cs"], tie=["ct", "cs"])


@query
def asof_failure_rate(spark, sf):
    age = minutes(F.col("t_cut"), F.col("obs"))
    reason = labels.first_reason({"unobserved": F.col("obs").isNull(), "a_cancelled_at_cutoff": F.col("cs") == "c", "stale_label": age > 24 * 60})
    rows = _views_at_cutoffs(spark, sf).select("cutoff_min", F.coalesce(reason, F.lit("none")).alias("reason"), (F.col("value") > 60).cast("int").alias("fail"), age.alias("age"), minutes(F.coalesce("ct", "ts"), F.col("ts")).alias("delay"))
    return rows.groupBy("cutoff_min", "reason").agg(F.count("*").alias("n"), r6(F.avg("fail")).alias("fail_rate"), r6(F.avg("age")).alias("mean_age_min"), r6(F.avg("delay")).alias("mean_delay_min"))


@query
def asof_states(spark, sf):
    return _views_at_cutoffs(spark, sf).select("event_id", "cutoff_min", micros("obs").alias("obs_us"), micros("ct").alias("ct_us"), "cs")


@query
def last_poll_by_hub(spark, sf):
    asked = events(spark, sf).where("event_type = 'purchase'").select("event_id", "eva", shifted(F.col("ts"), -30).alias("t_cut"))
    polls = events(spark, sf).where("event_type = 'click'").select("eva", F.col("ts").alias("t"))
    out = asof.last_time(asked, polls, "eva", "t_cut", "t", "poll")
    age = minutes(F.col("t_cut"), F.col("poll"))
    return out.select("event_id", micros("poll").alias("poll_us"), F.coalesce(age <= 15, F.lit(False)).alias("fresh"))


@query
def plan_latest_versions(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("brand", F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey"))).withColumn("tax", F.when(F.col("l_suppkey") % 4 != 0, F.round(F.col("l_tax") * 100).cast("long")))
    tie = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax"]
    out = asof.latest_version(rows, ["l_orderkey"], "l_shipdate", ["brand", "tax", "l_returnflag"], tie)
    return out.select("l_orderkey", "brand", "tax", F.col("l_returnflag").alias("flag"), F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


@query
def final_states(spark, sf):
    out = asof.last_state(observations(spark, sf), ["key"], "obs", ["ct", "cs"])
    return out.select("key", micros("obs").alias("obs_us"), micros("ct").alias("ct_us"), "cs")


@query
def polls_and_span(spark, sf):
    polls = observations(spark, sf).select("eva", F.date_trunc("minute", "obs").alias("t")).distinct()
    return polls.groupBy("eva").agg(F.count("*").alias("polls"), F.min(micros("t")).alias("first_us"), F.max(micros("t")).alias("last_us"))


@query
def realtime_coverage(spark, sf):
    seen = observations(spark, sf).where("cs IS NULL").select("key").distinct().withColumn("seen", F.lit(1))
    rows = plan(spark, sf).withColumn("key", F.col("trip").cast("long")).join(seen, "key", "left")
    return rows.groupBy(F.when(F.col("cat") == "Bus", "bus").otherwise("train").alias("kind")).agg(F.count("*").alias("events"), r6(F.avg(F.col("seen").isNotNull().cast("int"))).alias("observed"))


# ---- pairs, rules, labels


def _judged(spark, sf):
    """All pairs, for queries that count them in one pass: never written."""
    return pairs.judged_pairs(plan(spark, sf), hubs(spark, sf), min_slack=4, max_slack=60)


def _candidates(spark, sf):
    return pairs.connections(plan(spark, sf), hubs(spark, sf), min_slack=4, max_slack=60)


@query
def interval_pairs(spark, sf):
    p = plan(spark, sf)
    both = pairs.interval_join(p.where("event = 'ar'").select("eva", "pt", "trip"), p.where("event = 'dp'").select("eva", "pt", "trip"), "eva", "pt", 5, 90)
    other = both.where(~F.col("trip_a").eqNullSafe(F.col("trip_b")))
    return other.groupBy(F.col("eva_a").alias("eva"), bucket(F.col("slack_min"), (5, 10, 20, 30, 60, 91)).alias("bucket")).agg(F.count("*").alias("pairs"), r6(F.avg("slack_min")).alias("mean_slack"))


@query
def candidate_funnel(spark, sf):
    return pairs.funnel(_judged(spark, sf), _candidates(spark, sf), hubs(spark, sf)).select("hub", "step", F.col("pairs").cast("long").alias("pairs"))


@query
def transfer_candidates(spark, sf):
    c = _candidates(spark, sf)
    return c.select("hub", "stop_id_a", "stop_id_b", r6("planned_slack_min").alias("planned_slack_min"), "segment_a", "segment_b", "origin_a", "prev_station_a", F.col("n_stations_before_a").cast("long").alias("n_before"), "next_station_b", "destination_b", F.col("n_stations_after_b").cast("long").alias("n_after"))


def _dataset(spark, sf):
    c = save(_candidates(spark, sf)).withColumn("key_a", F.col("trip_a").cast("long")).withColumn("key_b", F.col("trip_b").cast("long"))
    obs = observations(spark, sf).select("key", "obs", "ct", "cs")
    polls = observations(spark, sf).select("eva", F.col("obs").alias("t"))
    return labels.at_cutoffs(labels.with_labels(c, obs), obs, polls, CUTOFFS, ambiguous=F.col("num_a").cast("long") % 23 == 0)


@query
def dataset_rows(spark, sf):
    return _dataset(spark, sf).select(
        "stop_id_a", "stop_id_b", "cutoff_min", "label_fail", "fail_reason", "exclusion_reason", "eligible", "b_cancel_known",
        *[F.round(F.col(c) * 6e7).cast("long").alias(c.replace("_min", "_us")) for c in ("db_delay_a_min", "db_delay_b_min", "db_slack_min", "real_slack_min", "collector_age_min")],
    )


@query
def dataset_summary(spark, sf):
    s = labels.summary(_dataset(spark, sf).withColumn("planned_slack_min", r6("planned_slack_min")).withColumn("db_slack_min", r6("db_slack_min")))
    return s.select("cutoff_min", "rows", "eligible", r6("fail_pct").alias("fail_pct"), r6("auc_planned").alias("auc_planned"), r6("auc_predicted").alias("auc_predicted"))


@query
def dataset_exclusions(spark, sf):
    return labels.exclusions(_dataset(spark, sf))


@query
def label_sensitivity(spark, sf):
    c = _candidates(spark, sf).withColumn("key_a", F.col("trip_a").cast("long")).withColumn("key_b", F.col("trip_b").cast("long"))
    rows = labels.with_labels(c, observations(spark, sf)).select("real_slack_min", F.explode(F.array(*[F.lit(m) for m in (3, 4, 5, 7)])).alias("min_transfer"))
    return rows.groupBy("min_transfer").agg(F.count("*").alias("pairs"), r6(F.avg(F.coalesce(F.col("real_slack_min") < F.col("min_transfer"), F.lit(False)).cast("int"))).alias("delay_fail"))


# ---- features


def _grid(spark, sf):
    p = plan(spark, sf).withColumn("key", F.col("trip").cast("long"))
    return grid.events_on_grid(p, observations(spark, sf))


@query
def hub_grid_state(spark, sf):
    # whole microseconds, cut where no mean of a few values lies, so that engines agree
    return grid.hub_state(_grid(spark, sf)).select("eva", micros("g").alias("g_us"), r6("hub_share_cancel").alias("share_cancel"), F.floor(F.col("hub_mean_delay") * 6e7 + 0.1234).alias("mean_delay_us"), r6("hub_share_late5").alias("share_late"))


@query
def line_grid_state(spark, sf):
    return grid.line_state(_grid(spark, sf)).select("eva", micros("g").alias("g_us"), "line", r6("line_recent_delay_a").alias("mean_delay"))


def _query_rows(spark, sf):
    return plan(spark, sf).where("event = 'ar'").select("stop_id", "eva", F.col("line").alias("line_a"), F.col("path").alias("path_a"), F.col("trip").cast("long").alias("key"), F.col("pt").alias("pt_a"), "first_seen", shifted(F.col("pt"), -30).alias("t_cut"))


@query
def hub_features(spark, sf):
    g = _grid(spark, sf)
    out = grid.with_hub_state(_query_rows(spark, sf), grid.hub_state(g), grid.line_state(g))
    return out.select("stop_id", r6("hub_share_cancel").alias("share_cancel"), r6("hub_mean_delay").alias("mean_delay"), r6("line_recent_delay_a").alias("line_delay"))


@query
def feeder_features(spark, sf):
    g = _grid(spark, sf)
    feeders = table(spark, sf, "region").select(F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_regionkey").cast("string").alias("eva"))
    out = grid.with_corridor(_query_rows(spark, sf), feeders, grid.hub_state(g), grid.line_state(g), "stop_id", "path_a", F.col("first_seen") <= F.col("t_cut"))
    return out.select("stop_id", r6("corridor_delay_a").alias("corridor_delay"), r6("corridor_line_delay_a").alias("corridor_line_delay"))


def _messages(spark, sf):
    e = events(spark, sf)
    text = F.concat(F.substring("event_type", 1, 1), F.lit(":"), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 4 == 0, "|h:7").otherwise(""))
    return features.message_sightings(e.select(F.col("user_id").alias("key"), F.col("ts").alias("obs"), text.alias("msgs")), "key", "msgs", "obs")


@query
def message_first_seen(spark, sf):
    return _messages(spark, sf).select("key", "type", "code", micros("obs").alias("obs_us"))


@query
def message_features(spark, sf):
    out = features.messages(_query_rows(spark, sf), _messages(spark, sf), "stop_id", "key", {"n_clicks": "c", "n_errors": "e", "n_notices": "h"})
    return out.select("stop_id", *[F.col(c).cast("long").alias(c) for c in ("n_clicks", "n_errors", "n_notices")])


@query
def plan_change_keys(spark, sf):
    return features.plan_changes(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate")


@query
def trend_features(spark, sf):
    out = features.trend(_query_rows(spark, sf), observations(spark, sf), "stop_id", "key", "pt_a", (60, 1440))
    return out.select("stop_id", F.round(F.col("trend_a_60") * 6e7).cast("long").alias("trend_60_us"), F.round(F.col("trend_a_1440") * 6e7).cast("long").alias("trend_1440_us"))


@query
def freshness_features(spark, sf):
    return features.freshness(_query_rows(spark, sf), observations(spark, sf), "key", "age_min").select("stop_id", r6("age_min").alias("age_min"))


@query
def context_features(spark, sf):
    rows = plan(spark, sf).select("stop_id", F.col("pt").alias("pt_a"), F.col("pp").alias("pp_a"), F.when(F.col("cat") == "S", F.col("pp")).alias("pp_b"), "cat")
    out = features.context(rows, holidays=("2024-01-01",))
    return out.select("stop_id", (r6("hour_sin") + 0.0).alias("hour_sin"), (r6("hour_cos") + 0.0).alias("hour_cos"), "day_type", "same_platform", segment(F.col("cat")).alias("segment"))


# ---- evaluation


@query
def auc_by_cutoff(spark, sf):
    return metrics.auc(predictions(spark, sf), ["cutoff_min"], "label", "p_model").select("cutoff_min", r6("auc").alias("auc"))


@query
def flag_quality(spark, sf):
    return metrics.flag_metrics(predictions(spark, sf), ["priority"], "label", "flag").select("priority", *[r6(c).alias(c) for c in ("precision", "recall", "false_alarms")])


@query
def recall_at_rule_precision(spark, sf):
    rows = predictions(spark, sf)
    rate = rows.groupBy("cutoff_min").agg(F.avg("label").alias("goal"))
    return metrics.recall_at_precision(rows.join(rate, "cutoff_min"), ["cutoff_min"], "label", "p_model", "goal").select("cutoff_min", r6("recall").alias("recall"), r6("threshold").alias("threshold"))


@query
def metric_table(spark, sf):
    out = metrics.metric_table(predictions(spark, sf), "label", ["p_model", "p_base", "flag"], "cutoff_min", ["priority", "status"])
    return out.select("cutoff_min", "slice", "value", "model", "n", *[r6(c).alias(c) for c in ("fail_rate", "mean_p", "log_loss", "brier", "auc")])


@query
def reliability_bins(spark, sf):
    return metrics.reliability(predictions(spark, sf), ["cutoff_min"], "label", "p_model").select("cutoff_min", "bin", "n", r6("mean_p").alias("mean_p"), r6("observed").alias("observed"))


@query
def log_loss_per_day(spark, sf):
    return metrics.per_day(predictions(spark, sf), "day", "label", ["p_model", "p_base"]).select("day", "n", r6("p_model").alias("p_model"), r6("p_base").alias("p_base"))


@query
def bootstrap_over_days(spark, sf):
    return metrics.bootstrap_gain(predictions(spark, sf), "day", "label", "p_model", "p_base").select("days", "rows", *[r6(c).alias(c) for c in ("day_share", "log_loss_gain", "log_loss_gain_low", "log_loss_gain_high", "brier_gain", "brier_gain_low", "brier_gain_high", "auc_diff", "auc_diff_low", "auc_diff_high")])


@query
def gain_by_fold(spark, sf):
    daily = metrics.per_day(predictions(spark, sf), "day", "label", ["p_model", "p_base"]).withColumn("gain", 1 - F.col("p_model") / F.col("p_base"))
    return daily.groupBy((F.col("day") % 4).alias("fold")).agg(F.count("*").alias("days"), r6(F.avg("gain")).alias("mean_gain"), F.count_if(F.col("gain") > 0).alias("days_better"))


@query
def psi_of_inputs(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("discount", F.when(F.col("l_linenumber") != 7, F.col("l_discount")))
    training, now = rows.where("l_shipdate < TIMESTAMP '1998-01-01'"), rows.where("l_shipdate >= TIMESTAMP '1998-01-01'")
    out = drift.drift_report(training, now, ["l_quantity", "discount", "l_extendedprice"], ["l_returnflag"], exact=True)
    return out.select("input", r6("psi").alias("psi"), "level", "status")


@query
def reference_profile(spark, sf):
    rows = table(spark, sf, "customer")
    bounds = drift.edges(rows, ["c_acctbal"], exact=True)
    return drift.shares(rows, ["c_acctbal"], ["c_mktsegment"], bounds).select("input", "bin", r6("share").alias("share"))


@query
def history_rate_model(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", bucket(F.col("o_totalprice"), (0, 50000, 150000, 300000, 450000)).alias("b"), F.col("c_mktsegment").alias("hub"), F.col("o_orderpriority").alias("seg"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_orderdate").alias("d"))
    fit = rows.where("d < TIMESTAMP '1996-01-01' AND hub <> 'MACHINERY'")
    tables = models.history_rates(fit, "y", ["b", "hub", "seg"], 50.0)
    return models.predict_history(rows, tables, ["b", "hub", "seg"]).select("o_orderkey", r6("p").alias("p"))


@query
def learned_models(spark, sf):
    rows = predictions(spark, sf).select("label", "day", "cutoff_min", "priority", "p_base", F.when(F.col("l_linenumber") != 3, F.col("p_model")).alias("x"))
    makers = {"lr": lambda: models.Learner(["x", "p_base"], ["priority"]), "gbt": lambda: models.Learner(["x", "p_base"], ["priority"], kind="gbt")}
    n = rows.select("day").distinct().count()
    out = models.predict_folds(rows, "label", "day", folds.fold_table(rows, "day", max(1, n // 2), max(1, n // 4)), makers)
    return metrics.metric_table(out, "label", ["lr", "gbt"], "cutoff_min", [])


# ---- monitoring


LOGGED_ROWS_A_TASK = 250_000


def _logged(spark, sf):
    """A log with repeats, and the outcomes of all its rows."""
    p = predictions(spark, sf)
    key = ["l_orderkey", "l_linenumber"]
    # a task sorts about as many rows whatever the size of the tables
    parts = max(spark.sparkContext.defaultParallelism, table(spark, sf, "lineitem").count() // LOGGED_ROWS_A_TASK + 1)
    log = p.select(*key, "p_model", "p_base", "flag", "cutoff_min", (F.col("l_orderkey") % 40 + F.round(F.col("p_model") * 10)).alias("lag_s"), (F.col("l_orderkey") % 200 + F.col("p_base")).alias("age_s"))
    first = monitor.first_logged(log, key, "lag_s", parts)
    outcome = p.repartition(parts, *key).groupBy(*key).agg(F.max("label").alias("label"), (F.max("l_linenumber") != 5).alias("eligible"))
    return monitor.outcomes(first, outcome, key)


@query
def prediction_outcomes(spark, sf):
    out = monitor.operations(_logged(spark, sf), ["cutoff_min"], "lag_s", "age_s", exact=True)
    return out.select("cutoff_min", "predictions", "evaluated", "excluded", "not_a_candidate", *[r6(c).alias(c) for c in ("coverage", "lag_s_p50", "lag_s_p95", "age_s_p50", "age_s_p95", "lag_s_max", "age_s_max")])


@query
def performance_report(spark, sf):
    out = monitor.performance(_logged(spark, sf), ["cutoff_min"], "label", "p_model", "p_base", "flag")
    return out.select("cutoff_min", "model_n", *[r6(c).alias(c) for c in ("model_log_loss", "base_log_loss", "model_brier", "model_auc", "rule_precision", "rule_recall", "recall_at_rule_precision", "gain")])


@query
def feature_skew(spark, sf):
    o = table(spark, sf, "orders")
    live_ = o.select("o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 7 != 0, F.month("o_orderdate")).alias("month"))
    offline = o.select("o_orderkey", (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 0.5).otherwise(0.0)).alias("price"), F.when(F.col("o_orderkey") % 14 != 0, F.month("o_orderdate")).alias("month"))
    return monitor.skew(live_, offline, ["o_orderkey"], ["price", "month"]).select("feature", "rows", r6("equal_share").alias("equal_share"), r6("mean_abs_diff").alias("mean_abs_diff"))


@query
def missing_order_days(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    return monitor.missing_days(days, "d").select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query
def finished_days(spark, sf):
    days = events(spark, sf).select(service_day(F.col("ts")).alias("day")).distinct()
    days = days.withColumn("day_end", day_start(F.date_add("day", 1)))
    reports = days.where(F.dayofmonth("day") % 3 == 0)
    return monitor.finished_days(days, reports, span(spark, sf)).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query
def worst_psi_by_segment(spark, sf):
    counts = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    return monitor.worst(counts, ["c_mktsegment"], "o_orderpriority", "n")


# ---- profiles


@query
def null_share_per_column(spark, sf):
    p = plan(spark, sf)
    return profile.null_shares(p, ["line", "path", "wings", "tra", "pt", "cat"]).select("column", r6("null_share").alias("null_share"))


@query
def key_uniqueness(spark, sf):
    keys = {"order": ["l_orderkey"], "order,line": ["l_orderkey", "l_linenumber"], "order,part,supplier": ["l_orderkey", "l_partkey", "l_suppkey"]}
    return profile.uniqueness(table(spark, sf, "lineitem"), keys)


@query
def rule_agreement(spark, sf):
    rows = table(spark, sf, "lineitem")
    out = profile.shares_of(rows, ["l_linestatus"], {"returned": F.col("l_returnflag") == "R", "discount_at_tax": F.round(F.col("l_discount") * 100) == F.round(F.col("l_tax") * 100), "many": F.when(F.col("l_linenumber") != 2, F.col("l_quantity") > 25)})
    return out.select("l_linestatus", "rows", *[r6(c).alias(c) for c in ("returned", "discount_at_tax", "many")])


@query
def delay_distribution(spark, sf):
    return profile.distribution(events(spark, sf), ["event_type"], "value", (0.01, 0.25, 0.5, 0.75, 0.99), exact=True).select("event_type", "n", *[r6(c).alias(c) for c in ("mean", "p01", "p25", "p50", "p75", "p99")])


@query
def rides_contiguity(spark, sf):
    rides = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("stops"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.count_distinct("l_linenumber").alias("numbers"), ((F.unix_micros(F.max(F.col("l_shipdate").cast("timestamp"))) - F.unix_micros(F.min(F.col("l_shipdate").cast("timestamp")))) / 3.6e9).alias("span_h"))
    share = lambda c: r6(F.avg(c.cast("int")))
    return rides.agg(F.count("*").alias("rides"), share(F.col("numbers") == F.col("hi") - F.col("lo") + 1).alias("contiguous"), share(F.col("numbers") < F.col("stops")).alias("repeated"), share(F.col("lo") == 1).alias("from_one"), r6(F.avg("span_h")).alias("mean_span_h"))


@query
def rows_per_day(spark, sf):
    e = events(spark, sf)
    return e.groupBy(F.date_format(service_day(F.col("ts")), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows"), F.min(micros("ts")).alias("first_us"), F.max(micros("ts")).alias("last_us"), F.count_if(F.col("value").isNull()).alias("without_value"))


@query
def order_violations(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_linenumber IS NOT NULL")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    rows = rows.withColumn("back", F.col("l_shipdate") < F.lag("l_shipdate").over(w))
    return rows.groupBy("l_linestatus").agg(F.count("back").alias("steps"), r6(F.avg(F.col("back").cast("int"))).alias("violations"))


@query
def poll_gaps(spark, sf):
    gaps = asof.poll_gap(events(spark, sf), ["eva"], "ts")
    return profile.distribution(gaps, ["eva"], "gap_s", (0.5, 0.9, 1.0), exact=True).select("eva", "n", *[r6(c).alias(c) for c in ("mean", "p50", "p90", "p100")])


@query
def trailing_counts(spark, sf):
    return asof.trailing_count(events(spark, sf), ["eva"], "ts", 1800, "n").select("event_id", "n")


@query
def top_lines_per_hub(spark, sf):
    return profile.top_k(plan(spark, sf), ["eva"], "line", 3).select("eva", "line", "n", "rank", r6("share").alias("share"))


@query
def station_activity(spark, sf):
    e = events(spark, sf)
    out = e.groupBy("user_id").agg(F.count("*").alias("rows"), F.count_distinct(F.to_date("ts")).alias("days"), F.any_value(F.col("eva")).alias("eva"))
    return out.select("user_id", "eva", "rows", r6(F.col("rows") / F.col("days")).alias("rows_per_day")).orderBy(F.desc("rows"), "user_id").limit(20)


@query
def pair_miss_rates(spark, sf):
    e = events(spark, sf).select("eva", F.col("ts").alias("pt"), "value", "event_type", F.col("user_id").alias("rid"))
    both = pairs.interval_join(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "eva", "pt", 5, 30).where(~F.col("rid_a").eqNullSafe(F.col("rid_b")))
    missed = (F.col("slack_min") + (F.col("value_b") - F.col("value_a")) / 60 < 5).cast("int")
    return both.groupBy(F.col("eva_a").alias("eva"), bucket(F.col("slack_min"), (5, 10, 15, 20, 31)).alias("bucket")).agg(F.count("*").alias("pairs"), r6(F.avg(missed)).alias("missed"))


@query
def requests_by_type(spark, sf):
    return events(spark, sf).groupBy("event_type", (F.col("user_id") % 3).alias("status")).agg(F.count("*").alias("requests"), F.count_distinct("user_id").alias("stations"), F.min(micros("ts")).alias("first_us"), F.max(micros("ts")).alias("last_us"))


@query
def snapshots_per_key(spark, sf):
    per = observations(spark, sf).groupBy("key").agg(F.count("*").alias("snapshots"), F.count_distinct("ct").alias("changes"), F.max((F.col("cs") == "c").cast("int")).alias("cancelled"))
    per = save(per)
    middle = quantiles.quantile_columns(per, [], {"snapshots": ("snapshots", (0.5, 0.9)), "changes": ("changes", (0.5,))}).select(r6("snapshots_p50").alias("p50"), r6("snapshots_p90").alias("p90"), r6("changes_p50").alias("changes_p50"))
    return quantiles.beside(per.agg(F.count("*").alias("keys"), r6(F.avg(F.coalesce("cancelled", F.lit(0)))).alias("cancelled")), middle, [])


@query
def validity_by_zone(spark, sf):
    e = events(spark, sf).select("ts", "value", F.explode(F.array(F.lit("UTC"), F.lit("Europe/Berlin"), F.lit("America/New_York"))).alias("zone"))
    return e.groupBy("zone", F.hour(F.from_utc_timestamp("ts", F.col("zone"))).alias("hour")).agg(F.count("*").alias("rows"), r6(F.avg((F.col("value") > 60).cast("int"))).alias("share"))


@query
def hour_offsets(spark, sf):
    asked = F.regexp_extract("props", r'"k": (\d+)', 1).cast("int")
    rows = events(spark, sf).select((F.round(asked / 4.0) - F.hour("ts")).cast("int").alias("offset"))
    return rows.groupBy("offset").agg(F.count("*").alias("n"))


@query
def feeder_volume(spark, sf):
    gaps = asof.poll_gap(events(spark, sf).where("event_type = 'click'"), ["eva"], "ts")
    gaps = save(gaps.select("eva", "user_id", "gap_s"))
    middle = quantiles.exact_quantiles(gaps, ["eva"], "gap_s", (0.5,)).select("eva", r6(F.col("quantiles")[0]).alias("median_gap_s"))
    return quantiles.beside(gaps.groupBy("eva").agg(F.count_distinct("user_id").alias("runs"), F.count("*").alias("observations")), middle, ["eva"])


@query
def preferred_run_rows(spark, sf):
    rows = plan(spark, sf)
    return profile.preferred(rows, ["eva", "trip"], F.when(F.col("event") == "dp", 0).otherwise(1), ["pt", "stop_id"]).select("eva", "trip", "event", "stop_id")


@query
def snapshot_match_rate(spark, sf):
    left = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return profile.match_rate(left, table(spark, sf, "part").where("p_size > 25"), ["p_partkey"])


@query
def unmatched_names(spark, sf):
    names = table(spark, sf, "nation").select(F.regexp_replace("n_name", "_1", "-1").alias("name")).where("name LIKE '%-1%' OR name LIKE '%2%'")
    return profile.closest_names(names, table(spark, sf, "nation").select(F.col("n_name").alias("name"))).select("name", "close", "distance", "rank")


@query
def prognosis_error(spark, sf):
    d = _dataset(spark, sf).where("eligible")
    err = F.abs(F.col("db_delay_a_min") - F.col("delay_a_final_min"))
    return d.groupBy("cutoff_min").agg(F.count("*").alias("rows"), r6(F.avg(err)).alias("mae"), r6(F.avg(F.col("b_cancel_known").cast("int"))).alias("known_cancel"))


@query
def partial_correlation(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", F.when(F.col("l_linenumber") != 4, F.col("l_discount")).alias("d"), "l_tax")
    return profile.partial_correlation(rows, "l_extendedprice", "l_quantity", ["d", "l_tax"]).select("n", r6("partial_corr").alias("partial_corr"))


@query
def period_pivot(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
    return rows.agg(r6(F.avg("o_totalprice")).alias("mean_price"))


@query
def hub_connection_counts(spark, sf):
    c = _candidates(spark, sf).groupBy("hub").agg(F.count("*").alias("n"))
    return hubs(spark, sf).join(c, "hub", "left").select("hub", F.coalesce("n", F.lit(0)).alias("connections"))


@query
def station_cover(spark, sf):
    reach = plan(spark, sf).where("event = 'ar'").select("stop_id", F.explode(path(F.col("path"))).alias("station"))
    weights = plan(spark, sf).where("event = 'ar'").select("stop_id", (F.col("num").cast("long") % 3 + 1).alias("weight"))
    return profile.greedy_cover(reach, "station", "stop_id", weights, 3).select("pick", "item", "added", r6("share").alias("share"))


@query
def risky_connections(spark, sf):
    d = _dataset(spark, sf).where("eligible AND cutoff_min = 30")
    d = save(d.select("hub", "stop_id_a", "stop_id_b", "db_slack_min", "pt_a", "cat_a", "line_a", "num_a", "planned_slack_min"))
    totals = d.groupBy("hub").agg(F.count("*").alias("hub_total"))
    out = d.withColumn("risk", r6(1 / (1 + F.exp((F.col("db_slack_min") - 8) / 4)))).join(totals, "hub")
    return out.where("risk >= 0.2").orderBy(F.desc("risk"), "pt_a", "stop_id_a", "stop_id_b").limit(50).select("hub", "stop_id_a", "stop_id_b", "risk", "hub_total", display_name(F.col("cat_a"), F.col("line_a"), F.col("num_a")).alias("train_a"), nearest_cutoff(F.col("planned_slack_min"), CUTOFFS).alias("nearest"))


@query
def seeded_examples(spark, sf):
    return profile.seeded_sample(table(spark, sf, "supplier"), "s_suppkey", 10, seed=3).select("s_suppkey", "s_name")


@query
def local_clock(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyMMdd").alias("d"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0").alias("h"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0").alias("m"))
    text = F.concat("d", "h", "m")
    out = o.select("o_orderkey", micros_of(raw_to_utc(text)).alias("utc_us"), is_ambiguous(text).alias("ambiguous"), F.date_format(service_day(raw_to_utc(text)), "yyyy-MM-dd").alias("day"), trip_key(F.concat_ws("-", F.lit("-7"), "d", "h")).alias("trip"))
    return out


def micros_of(c: Column) -> Column:
    return F.unix_micros(c)


@query
def schema_census(spark, sf):
    out = raw.schema_census(spark, [f"{sf}/{t}.parquet" for t in ("orders", "lineitem", "customer", "part", "region", "nation")])
    return out.select("signature", "files", "rows")


@query
def page_element_census(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("html").alias("body"))
    return raw.element_census(pages, 3).select("element", "attribute", "value", "n", "rank")


@query
def status_by_source(spark, sf):
    o = observations(spark, sf).select(F.col("eva").alias("source"), (F.col("key") % 2).cast("string").alias("eva"), F.col("key").alias("stop_id"), F.col("obs").alias("collected_at"), F.when(F.col("cs").isNull(), F.col("ct")).alias("ct"), "cs")
    return raw.collector_status(o).select("source", "eva", "rows", "stops", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), "with_ct", "cancelled")


@query
def data_age_status(spark, sf):
    out = live.age_status(events(spark, sf), "eva", "ts", span(spark, sf), 60, 600)
    return out.select("eva", r6("age_s").alias("age_s"), "status")


@query
def overall_age_status(spark, sf):
    out = live.overall_status(live.age_status(events(spark, sf), "user_id", "ts", span(spark, sf), 3600, 86400))
    return out.select(r6("age_s").alias("age_s"), "status")


@query
def deduplicated_tail(spark, sf):
    o = observations(spark, sf)
    merged = raw.merged_tail(o.where(F.col("obs") <= span(spark, sf, 0.5)), o, "obs", span(spark, sf, 0.4), span(spark, sf, 0.75), ["key", "obs", "ct", "cs"])
    return merged.groupBy("eva").agg(F.count("*").alias("rows"), F.max(micros("obs")).alias("last_us"))


@query
def carried_states(spark, sf):
    o = observations(spark, sf)
    middle = span(spark, sf, 0.5)
    carried = live.carried_state(o.limit(0), o.where(F.col("obs") < middle), ["key"], "obs", ["ct", "cs"])
    out = live.carried_state(carried, o.where(F.col("obs") >= middle), ["key"], "obs", ["ct", "cs"], span(spark, sf, 0.3))
    return out.select("key", micros("obs").alias("obs_us"), "cs")


@query
def scoring_status(spark, sf):
    rows = plan(spark, sf).where("event = 'ar'").select("stop_id", "eva", shifted(F.col("pt"), -10).alias("t"), (F.col("cat") == "Bus").alias("a_cancelled"), (F.col("pp") == "3").alias("ambiguous"))
    polls = events(spark, sf).where("event_type = 'error'").select("eva", F.col("ts").alias("p"))
    return live.input_status(rows, polls, "eva", "t", "p").groupBy("eva", "status").agg(F.count("*").alias("n"))
