"""Registered queries that run whole flows: raw files to parsed tables, streams, folds, bundles, scoring, reports.

Their input files are written by Spark from the driver's tables first, so that the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import ZONE, minutes, shifted
from ..functions.trains import path, segment
from ..operators import bundle, folds, grid, labels, metrics, models, monitor, offline, profile, quantiles, selection, serving, sketches, snapshots
from ..sources import raw
from ..sources.scratch import save, scratch
from ..streaming import live, scoring, stored
from .bindings import CUTOFFS, events, hubs, observations, plan, predictions, span, table
from .queries import QUERIES, _candidates, _dataset, _grid, _judged, _messages, micros, query, r6

__all__ = ["QUERIES"]

#: Periods of the orders' days; test and robustness are set aside.
PERIODS = (folds.Period("train", "1995-01-01", "1996-12-31"), folds.Period("validation", "1997-01-01", "1997-12-31"), folds.Period("test", "1998-01-01", "1998-12-31"), folds.Period("robustness", "1999-07-01"))


# ---- raw responses, parsed tables


def _raw_files(spark: SparkSession, sf: str) -> str:
    """JSON lines of responses, one for each hub, source and hour: plans and changes of the events, and of errors a body that is no XML."""
    local = lambda t: F.date_format(F.from_utc_timestamp(t, ZONE), "yyMMddHHmm")
    attribute = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise(F.lit(""))
    p = plan(spark, sf)
    times = [attribute(n, F.col(c)) for n, c in (("pp", "pp"), ("l", "line"), ("ppth", "path"), ("wings", "wings"), ("tra", "tra"))]
    stop = F.concat(F.lit('<s id="'), "stop_id", F.lit('"><tl c="'), "cat", F.lit('" n="'), "num", F.lit('"/><'), "event", attribute("pt", local(F.col("pt"))), *times, F.lit("/></s>"))
    plans = p.select("eva", F.lit("plan").alias("source"), F.col("first_seen").alias("t"), stop.alias("stop"))
    e = events(spark, sf)
    ct = F.timestamp_micros((F.unix_micros("ts") + F.floor("value") * 1_000_000).cast("long"))
    change = F.concat(F.lit('<s id="'), F.col("event_id").cast("string"), F.lit('-1"><ar'), attribute("ct", local(ct)), attribute("cs", F.when(F.col("event_type") == "error", F.lit("c"))), F.lit('><m t="'), F.substring("event_type", 1, 1), F.lit('" c="'), F.get_json_object("props", "$.k"), F.lit('"/></ar></s>'))
    changes = e.select("eva", F.lit("fchg").alias("source"), F.col("ts").alias("t"), change.alias("stop"))
    hourly = plans.unionByName(changes).groupBy("eva", "source", F.date_trunc("hour", "t").alias("t")).agg(F.array_join(F.array_sort(F.collect_list("stop")), "").alias("stops"))
    body = F.concat(F.lit('<timetable station="Hub '), "eva", F.lit('">'), "stops", F.lit("</timetable>"))
    good = hourly.select("eva", "source", "t", body.alias("body"))
    broken = e.where("event_type = 'error'").select("eva", F.lit("fchg").alias("source"), F.col("ts").alias("t"), F.lit("503 <busy").alias("body"))
    rows = good.unionByName(broken).select(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("collected_at"), F.col("source").alias("_s"), "source", "eva", F.lit("u").alias("url"), F.lit(200).alias("status"), F.lit(5).alias("duration_ms"), "body", F.date_format("t", "yyyy-MM-dd").alias("_date"))
    out = scratch(spark)
    rows.repartition("_s", "_date").drop("_s").withColumn("_p", F.col("source")).write.partitionBy("_p", "_date").option("compression", "gzip").json(out)
    return out


def _parsed_columns(rows: DataFrame) -> DataFrame:
    return rows.select("eva", "source", "stop_id", "trip_key", "event", "tl_category", "tl_number", "line", "pp", micros("pt").alias("pt_us"), micros("ct").alias("ct_us"), "cs", "ppth", "wings", "tra", "event_msgs", micros("collected_at").alias("seen_us"), "station_name")


@query
def parsed_responses(spark, sf):
    return _parsed_columns(raw.parse_responses(raw.read_raw(spark, _raw_files(spark, sf)).where("_bad IS NULL")))


@query
def rebuilt_table_counts(spark, sf):
    return raw.rebuild_parsed(spark, _raw_files(spark, sf), scratch(spark))


def _parsed_table(spark, sf) -> str:
    out = scratch(spark)
    raw.write_parsed(raw.parse_responses(raw.read_raw(spark, _raw_files(spark, sf)).where("_bad IS NULL")), out)
    return out


@query
def parsed_rows_per_day(spark, sf):
    rows = raw.check_version(raw.read_parsed(spark, _parsed_table(spark, sf)))
    return rows.groupBy("source", F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows"), F.count_distinct("stop_id").alias("stops"))


@query
def loaded_window(spark, sf):
    """Everything of a window, with later plan versions of every third train that aren't stored yet: moved by three hours and without line."""
    t0, t1 = span(spark, sf, 0.4), span(spark, sf, 0.6)
    rows = raw.read_parsed(spark, _parsed_table(spark, sf))
    moved = rows.where((F.col("source") == "plan") & (F.col("tl_number").cast("long") % 3 == 0))
    moved = moved.withColumn("collected_at", F.col("collected_at") + F.expr("INTERVAL 20 MINUTES")).withColumn("pt", F.col("pt") + F.expr("INTERVAL 3 HOURS")).withColumn("line", F.lit(None).cast("string"))
    w = raw.load_window(rows, t0, t1, ["0", "1", "2"], moved)
    none = F.lit(None).cast("string")
    part = lambda name, df, eva, key, what, a, b: df.select(F.lit(name).alias("part"), eva.alias("eva"), key.alias("key"), what.alias("what"), micros(a).alias("first_us"), (micros(b) if b else F.lit(None).cast("long")).alias("second_us"))
    own = lambda *c: F.concat_ws("|", *[F.coalesce(F.col(x), F.lit("-")) for x in c])
    plans = part("plan", w.plan, F.col("eva"), own("stop_id", "event", "trip"), own("pp", "line", "path", "wings", "tra", "cat", "num"), "first_seen", "pt")
    changes = part("obs", w.obs, F.col("eva"), F.col("key"), F.col("cs"), "obs", "ct")
    return plans.unionByName(changes).unionByName(part("polls", w.polls, F.col("eva"), none, none, "t", None)).unionByName(part("span", w.span, none, none, none, "first", "last"))


@query
def latest_from_snapshot(spark, sf):
    """What each user last did and their last long value at 70 % of the time: from the second of two snapshots and the dates after it."""
    out = scratch(spark)
    log = events(spark, sf).select(F.to_date("ts").alias("date"), "user_id", "ts", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("doing"), F.when(F.col("value") > 60, F.col("value")).alias("late"))
    log.repartition("date", F.hour("ts")).write.partitionBy("date").parquet(f"{out}/log")
    stored_log = spark.read.parquet(f"{out}/log")
    how = (["user_id"], "ts", ["doing", "late"], ["event_id"])
    t = span(spark, sf, 0.7)
    days = spark.range(1).select(*[F.to_date(x).cast("string") for x in (span(spark, sf, 0.3), span(spark, sf, 0.5), t)]).first()
    for day in days[:2]:
        snapshots.write_snapshot(stored_log, f"{out}/snapshots", day, *how)
    found = snapshots.latest_at(stored_log, f"{out}/snapshots", t, days[2], *how)
    return found.select("user_id", "doing", r6("late").alias("late"), micros("first_seen").alias("first_us"))


@query
def profiled_months(spark, sf):
    """Months of orders stored as sketches, merged before and since 1998; `close` tells whether the sketched median is at most 0.5 % of the ranks away."""
    out = scratch(spark)
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice", "o_orderpriority")
    sketches.daily_profiles(o, "month", ["o_totalprice"], ["o_orderpriority"]).write.parquet(out)
    parts = []
    for name, when in (("before", "< '1998-01'"), ("since", ">= '1998-01'")):
        merged = save(sketches.merged_profiles(spark.read.parquet(out).where(f"day {when}")))
        middle = sketches.profile_quantiles(merged, [0.5]).select("input", F.col("quantiles")[0].alias("q"))
        close = o.where(f"month {when}").crossJoin(F.broadcast(middle)).groupBy("input").agg((F.abs(F.avg((F.col("o_totalprice") <= F.col("q")).cast("int")) - 0.5) <= 0.005).alias("close"))  # one row beside each
        parts.append(quantiles.beside(merged, close, ["input"]).select(F.lit(name).alias("stretch"), "input", "v", "rows", "missing", r6("low").alias("low"), r6("high").alias("high"), "close"))
    return parts[0].unionByName(parts[1])


@query
def replaced_days(spark, sf):
    """Days of orders written, every third written anew with other prices, and read back by a few columns with their records."""
    out = scratch(spark)
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("service_day"))
    raw.replace_days(o, out, meta={"version": "1"})
    raw.replace_days(o.where(F.substring("service_day", 6, 2).cast("int") % 3 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 2), out, meta={"version": "2"})
    sums = raw.read_days(spark, out, ["o_totalprice"]).groupBy("service_day").agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    meta = spark.read.parquet(f"{out}_meta").select(F.col("service_day").alias("_d"), F.col("rows").alias("recorded"), F.col("facts")["version"].alias("version"))
    return sums.join(meta, F.col("service_day") == F.col("_d")).select("service_day", "rows", "price", "recorded", "version")


@query
def historic_stop_keys(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("eva"), F.concat(F.when(F.col("l_partkey") % 2 == 0, F.lit("-")).otherwise(F.lit("")), F.col("l_partkey").cast("string")).alias("train_id"), F.col("l_shipdate").alias("day"), F.col("l_linenumber").cast("string").alias("nth"), "l_orderkey")
    return raw.historic_stops(rows).select("l_orderkey", "nth", "eva", "run_key", "stop_key")


# ---- streams


#: A file of a stream's part has at least so many rows, so each task that writes a part leaves a file.
ROWS_A_FILE = 200_000


def _in_parts(spark: SparkSession, rows: DataFrame, time: str, sf: str, shares=(1 / 3, 2 / 3)) -> DataFrame:
    """A stream of the rows, in parts by time that come one after another.

    A part is a batch: all parts have as many files, and a batch takes so many. Tasks write a file each, as many as the
    smallest part has rows for.
    """
    folder = scratch(spark)
    marks = [span(spark, sf, s) for s in shares]
    lows, highs = [None, *marks], [*marks, None]
    inside = [(F.lit(True) if low is None else F.col(time) > low) & (F.lit(True) if high is None else F.col(time) <= high) for low, high in zip(lows, highs, strict=True)]
    files = max(1, min(rows.agg(*[F.count_if(c) for c in inside]).first()) // ROWS_A_FILE)
    for c in inside:
        part = rows.where(c)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query
def streamed_parse(spark, sf):
    out = scratch(spark)
    live.parse_stream(raw.read_raw(spark, _raw_files(spark, sf), stream=True), out, scratch(spark)).awaitTermination()
    return _parsed_columns(spark.read.parquet(out).withColumn("source", F.col("source").cast("string")))


@query
def stored_states(spark, sf):
    """The last state of each key out of a keyed state store: every batch adds the keys that it changed."""
    out = scratch(spark)
    states = stored.last_states(_in_parts(spark, observations(spark, sf), "obs", sf), ["key"], "obs", ["ct", "cs"], keep="400 days")
    stored.start_stored(states, out, scratch(spark)).awaitTermination()
    return stored.read_states(spark, out, ["key"], "obs", ["ct", "cs"]).select("key", micros("obs").alias("obs_us"), micros("ct").alias("ct_us"), "cs")


@query
def online_outcomes(spark, sf):
    """Views are predictions, labels come 0 to 89 minutes later for two thirds of them and count within an hour.

    A last row of both streams, a year later, stands for the stream going on, so that all predictions are told.
    """
    e = events(spark, sf)
    ahead = F.lit(365 * 86_400_000_000)
    told = e.where("event_type = 'view'").select("event_id", "ts")
    made = e.where("event_type = 'view' AND event_id % 3 <> 0").select("event_id", F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 90) * 60_000_000).alias("known_at"), (F.col("event_id") % 5 != 0).alias("eligible"))
    end = e.agg(F.timestamp_micros(F.max(F.unix_micros("ts")) + ahead).alias("t"))
    streams = []
    for rows, time, mark in ((told, "ts", end.select(F.lit(-1).cast("long").alias("event_id"), F.col("t").alias("ts"))), (made, "known_at", end.select(F.lit(-1).cast("long").alias("event_id"), F.col("t").alias("known_at"), F.lit(None).cast("boolean").alias("eligible")))):
        streams.append(_in_parts(spark, rows.unionByName(mark), time, sf))
    out = scratch(spark)
    stored.start_stored(stored.online_outcomes(*streams, ["event_id"], "ts", "known_at", "60 minutes", late="3 days"), out, scratch(spark)).awaitTermination()
    return spark.read.parquet(out).where("event_id >= 0").select("event_id", micros("ts").alias("scored_us"), micros("known_at").alias("known_us"), "outcome")


@query
def streamed_states(spark, sf):
    out = scratch(spark)
    stream = _in_parts(spark, observations(spark, sf), "obs", sf)
    live.state_stream(stream, out, scratch(spark), ["key"], "obs", ["ct", "cs"]).awaitTermination()
    last = spark.read.parquet(out)
    newest = last.agg(F.max("n").alias("_m"))
    return last.join(F.broadcast(newest), F.col("n") == F.col("_m")).select("key", micros("obs").alias("obs_us"), micros("ct").alias("ct_us"), "cs")


@query
def logged_once(spark, sf):
    out = scratch(spark)
    rows = events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").alias("t"), F.date_trunc("hour", "ts").alias("mark"))
    live.run_to(live.log_once(_in_parts(spark, rows, "t", sf), ["key", "mark"], "t", "mark"), out, scratch(spark)).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("key", micros("mark").alias("mark_us"))


@query
def streamed_hub_state(spark, sf):
    out = scratch(spark)
    p = plan(spark, sf).withColumn("key", F.col("trip").cast("long"))
    live.grid_state_stream(_in_parts(spark, observations(spark, sf), "obs", sf), p, out, scratch(spark), keep="3650 days").awaitTermination()
    return spark.read.parquet(out).select("eva", micros("g").alias("g_us"), r6("hub_share_cancel").alias("share_cancel"), F.floor(F.col("hub_mean_delay") * 6e7 + 0.1234).alias("mean_delay_us"), r6("hub_share_late5").alias("share_late"))


LIVE_NUMBERS = ("planned_slack_min", "db_slack_min", "db_delay_a_min", "db_delay_b_min", "b_cancel_known")


def _training(spark, sf) -> DataFrame:
    d = _dataset(spark, sf).where("eligible").withColumn("day", F.to_date("pt_a"))
    return save(d.select("day", "cutoff_min", "stop_id_a", "stop_id_b", F.col("label_fail").cast("int").alias("label_fail"), *[F.col(c).cast("double").alias(c) for c in LIVE_NUMBERS], "segment_a", "segment_b", "hub"))


def _bundle(spark, sf, rows: DataFrame) -> str:
    makers = {"p_model": models.Learner(LIVE_NUMBERS, ["segment_a", "segment_b", "hub"], rounds=5, kind="gbt"), "p_base": models.Learner(["planned_slack_min", "db_slack_min"])}
    out = scratch(spark)
    made = bundle.fit_bundle(rows, "label_fail", "day", "cutoff_min", makers, {"min_transfer": "4", "cutoffs": "60,30,10"}, {"p_base": 14})
    bundle.write_bundle(made, spark, out)
    return out


@query
def bundle_card(spark, sf):
    b = bundle.read_bundle(spark, _bundle(spark, sf, _training(spark, sf)), {"min_transfer": "4"})
    rates = b.rates.select(F.concat(F.lit("rate."), "cutoff").alias("key"), r6("fail_rate").cast("string").alias("value"))
    return spark.createDataFrame(sorted(b.card.items()), "key string, value string").unionByName(rates).select("key", F.when(F.col("key").startswith("rate."), F.format_number(F.col("value").cast("double"), 4)).otherwise(F.col("value")).alias("value"))


@query
def bundle_profile(spark, sf):
    b = bundle.read_bundle(spark, _bundle(spark, sf, _training(spark, sf)))
    return b.profile.where("input IN ('segment_a', 'segment_b', 'hub')").select("input", "bin", r6("share").alias("share"))


@query
def live_failure_rates(spark, sf):
    rows = _training(spark, sf)
    b = bundle.read_bundle(spark, _bundle(spark, sf, rows))
    return bundle.live_rates(b, rows.where(F.dayofmonth("day") > 15), "label_fail", "cutoff_min").select("cutoff", "rows", r6("fail_rate").alias("fail_rate"), r6("fit_rate").alias("fit_rate"), r6("difference").alias("difference"))


def _early_plan(spark, sf) -> DataFrame:
    """The plan, each event known two days ahead."""
    return plan(spark, sf).withColumn("key", F.col("trip").cast("long")).withColumn("first_seen", shifted(F.col("pt"), -2880))


def _scores(spark, sf) -> DataFrame:
    """Scores of the last of three triggers over the observations of the first 60 % of the time, a day ahead."""
    b = bundle.read_bundle(spark, _bundle(spark, sf, _training(spark, sf)))
    until = span(spark, sf, 0.6)
    stream = _in_parts(spark, observations(spark, sf).where(F.col("obs") <= until), "obs", sf, (0.2, 0.4))
    out = scratch(spark)
    scoring.score_stream(stream, _early_plan(spark, sf), hubs(spark, sf), b, out, scratch(spark), keep_h=24 * 3650, high_min=1440, max_slack=60).awaitTermination()
    return serving.latest_scores(spark.read.parquet(f"{out}/scores"))


@query
def scored_stream(spark, sf):
    s = _scores(spark, sf)
    shown = s.where("(status = 'ok') = (p_model IS NOT NULL) AND (status = 'ok') = (p_base IS NOT NULL)")
    return shown.select("stop_id_a", "stop_id_b", "hub", "status", micros("scored_at").alias("scored_us"), r6("minutes_to_arrival").alias("minutes_to_arrival"), r6("db_slack_min").alias("db_slack_min"), r6("b_cancel_known").alias("b_cancel_known"), r6("hub_mean_delay").alias("hub_mean_delay"), r6("hub_share_cancel").alias("hub_share_cancel"), r6("line_recent_delay_a").alias("line_delay"))


@query
def connections_at_risk(spark, sf):
    """Connections of one hub in the next hours with a risk from its slack, unscored ones included."""
    s = _fixed_scores(spark, sf)
    now = F.col("scored_at")
    out = serving.connections(s, now, hub="ASIA", within_min=600, min_risk=0.2, include_unscored=True)
    return out.select("stop_id_a", "stop_id_b", "status", r6("risk").alias("risk"), r6("minutes_to_arrival").alias("minutes_to_arrival"), "cutoff_min", "train_a", "train_b", "arrives", "departs")


@query
def one_connection(spark, sf):
    s = _fixed_scores(spark, sf)
    first = s.agg(F.min(F.struct("pt_a", "stop_id_a", "stop_id_b"))).first()[0]
    a, b = (first["stop_id_a"], first["stop_id_b"]) if first else ("", "")
    return serving.connection(s, F.col("scored_at"), a, b).select("stop_id_a", "stop_id_b", "hub", "status", r6("risk").alias("risk"), "arrives")


def _fixed_scores(spark, sf) -> DataFrame:
    """Pairs that pass the rules and arrive after 60 % of the time, with a risk that is a function of their slack."""
    now = span(spark, sf, 0.6)
    c = _candidates(spark, sf).where(F.col("pt_a") > now)
    status = F.when(F.col("num_a").cast("long") % 11 == 0, "collector_gap").otherwise("ok")
    return save(c.withColumn("scored_at", now).withColumn("status", status).withColumn("p_model", F.when(F.col("status") == "ok", 1 / (1 + F.exp((F.col("planned_slack_min") - 8) / 4)))))


# ---- folds, models, choices


def _order_days(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.trunc("o_orderdate", "month").alias("month"), "o_totalprice")


@query
def day_periods(spark, sf):
    return folds.calendar(_order_days(spark, sf), "day", PERIODS).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "period", "rows")


@query
def unlocked_rows(spark, sf):
    rows = _order_days(spark, sf)
    part = folds.days_of(rows, "day", PERIODS, "validation", locked=("test", "robustness"))
    closed = 0
    try:
        folds.checked(rows, "day", PERIODS, ("test", "robustness"))
    except folds.LockedDays:
        closed = 1
    return folds.checked(part, "day", PERIODS, ("test", "robustness")).agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.lit(closed).alias("locked_read_refused"))


@query
def fold_days(spark, sf):
    return folds.fold_table(_order_days(spark, sf), "month", 12, 3, window=400).select("fold", F.date_format("day", "yyyy-MM-dd").alias("day"), "role")


@query
def left_out_months(spark, sf):
    return folds.leave_one_out(_order_days(spark, sf), "month").groupBy("fold").agg(F.count_if(F.col("role") == "fit").alias("fit"), F.max(F.when(F.col("role") == "evaluate", F.date_format("day", "yyyy-MM-dd"))).alias("evaluated"))


@query
def rule_table(spark, sf):
    d = _dataset(spark, sf).where("eligible").withColumn("rule", models.rule(F.col("db_slack_min"), F.col("b_cancel_known"))).withColumn("error", F.abs(F.col("db_delay_a_min") - F.col("delay_a_final_min"))).withColumn("fail", F.col("label_fail").cast("int"))
    rows = save(d.select("cutoff_min", "hub", "fail", "rule", "error", "b_cancel_known"))
    facts = rows.groupBy("cutoff_min", "hub").agg(F.count("*").alias("rows"), F.avg("error").alias("mae"), F.avg(F.col("b_cancel_known").cast("int")).alias("known_cancel")).where("rows >= 200")
    quality = metrics.flag_metrics(rows, ["cutoff_min", "hub"], "fail", "rule")
    return facts.join(quality, ["cutoff_min", "hub"]).select("cutoff_min", "hub", "rows", r6("mae").alias("mae"), r6("known_cancel").alias("known_cancel"), r6("precision").alias("precision"), r6("recall").alias("recall"))


@query
def decision_thresholds(spark, sf):
    out = metrics.decision_layer(predictions(spark, sf), ["cutoff_min"], "label", "p_model", "flag")
    return out.select("cutoff_min", *[r6(c).alias(c) for c in ("precision", "threshold", "recall", "hit", "false_alarm", "missed", "quiet")])


def _variant_scores(spark, sf) -> DataFrame:
    """Fixed scores in the place of refits: the one in use, a reseeded one, one without a group, one with a new group on later days."""
    p = predictions(spark, sf)
    noisy = (F.col("p_model") * 0.98 + 0.01 * F.col("p_base"))
    return p.select(
        "label", "day", "cutoff_min", F.col("priority"), F.col("p_model").alias("in_use"), noisy.alias("reseeded"), (F.col("p_model") * 0.5 + F.col("p_base") * 0.5).alias("without_hub"),
        (F.col("p_model") * 0.6 + 0.1 + F.col("label") * 0.2).alias("with_trend"), F.when(F.col("day") % 12 < 6, F.col("p_model") * 0.9 + F.col("label") * 0.05).alias("with_feeder"), F.when(F.col("day") % 12 < 6, F.col("p_model")).alias("in_use_from_feeder"),
    )


USED = selection.Setup(groups=("slack", "hub"))
ASKED = (*selection.about_groups(USED, {"hub": None, "trend": None, "feeder": 1}), selection.noise_floor(USED))
#: The columns of _variant_scores that stand in for the setups' predictions.
FIXED = dict(zip(selection.columns_of(ASKED), ("in_use", "without_hub", "with_trend", "with_feeder", "in_use_from_feeder", "reseeded"), strict=True))


@query
def variant_comparison(spark, sf):
    out = selection.compare(_variant_scores(spark, sf), ASKED, FIXED, "label", "day", "cutoff_min")
    return out.select("subject", "kind", "cutoff", "days", "rows", *[r6(c).alias(c) for c in ("gain", "low", "high", "day_share", "auc_diff")])


@query
def group_verdicts(spark, sf):
    out = selection.verdicts(selection.compare(_variant_scores(spark, sf), ASKED, FIXED, "label", "day", "cutoff_min"))
    return out.select("subject", "kind", r6("gain").alias("gain"), r6("least").alias("least"), "passes", F.array_join("failed", ",").alias("failed"))


@query
def gains_per_slice(spark, sf):
    rows = _variant_scores(spark, sf)
    return metrics.gains_by(rows, ["cutoff_min", "priority"], "label", "with_trend", "in_use").select("cutoff_min", "priority", "rows", r6("gain").alias("gain"))


def _rows_to_fit(spark, sf) -> DataFrame:
    p = predictions(spark, sf).withColumn("quantity", (F.col("l_linenumber") * 7 % 11).cast("double"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "p_model", "p_base", "label", "priority", "status", "flag")
    return save(p.select(key.alias("id"), "label", "day", "cutoff_min", "p_model", "p_base", "quantity", "priority").dropDuplicates(["id"]))


@query
def tuned_settings(spark, sf):
    """A grid of settings of the logistic model on rolling folds, every candidate on every fold: verdicts and the winner."""
    rows = _rows_to_fit(spark, sf)
    n = rows.select("day").distinct().count()
    now = selection.Setup(settings=(("penalty", 1.0),))
    questions = selection.about_settings(now, {"penalty": (0.01, 1.0)}, (0, 24))
    columns = selection.columns_of(questions)
    make = lambda s: models.Learner(["p_model", "p_base"], seed=s.seed, **dict(s.settings))
    scored = save(selection.predict_setups(rows, ["id"], "label", "day", columns, make, max(1, n // 2), max(1, n // 3)))
    judged = save(selection.verdicts(selection.compare(scored, questions, columns, "label", "day", "cutoff_min"), selection.Bar(gain=0.002, days=0.0)))
    return judged.select("subject", "passes", F.lit(selection.winner(judged)).alias("winner"))


@query
def narrowed_settings(spark, sf):
    """The same kind of search by successive narrowing: candidates that cannot win leave after the first folds."""
    rows = _rows_to_fit(spark, sf)
    n = rows.select("day").distinct().count()
    now = selection.Setup(settings=(("penalty", 1.0),))
    questions = selection.about_settings(now, {"penalty": (1e-6, 0.01, 1.0)}, (0,))
    make = lambda s: models.Learner(["p_model", "p_base"], seed=s.seed, **dict(s.settings))
    judged, fits = selection.narrow_settings(rows, ["id"], "label", "day", "cutoff_min", now, questions, make, max(1, n // 2), max(1, n // 6), selection.Bar(gain=0.002))
    return judged.select("subject", r6("gain").alias("gain"), "passes", F.lit(fits).alias("fits"))


@query
def chosen_groups(spark, sf):
    """Groups of columns chosen with real refits, and the check of all changes together against the best one alone."""
    rows = _rows_to_fit(spark, sf)
    n = rows.select("day").distinct().count()
    held = {"score": ["p_model"], "base": ["p_base"], "place": ["quantity"]}
    make = lambda s: models.Learner([c for g in s.groups for c in held.get(g, ())], ["priority"] * ("priority" in s.groups), seed=s.seed)
    choice, judged = selection.choose_groups(rows, ["id"], "label", "day", "cutoff_min", selection.Setup(groups=("score", "base")), {"base": None, "place": None, "priority": None}, make, max(1, n // 2), max(1, n // 2))
    chosen = F.lit(",".join(choice.groups)).alias("chosen")
    return judged.select("subject", "kind", r6("gain").alias("gain"), "passes", chosen, F.lit(choice.together).cast("double").alias("together"), F.lit(choice.best_alone).cast("double").alias("best_alone"))


@query
def training_days(spark, sf):
    """The training table by service day and cutoff, each column in its class."""
    t = labels.training_table(_dataset(spark, sf))
    out = t.groupBy(F.date_format("service_day", "yyyy-MM-dd").alias("service_day"), "cutoff_min")
    safe = len(labels.feature_safe(t).columns) - len(labels.USAGE["key"])
    return out.agg(F.count("*").alias("rows"), F.count_if("eligible").alias("eligible"), F.count_if("label_fail").alias("failed"), F.lit(safe).alias("safe_columns"))


@query
def single_inputs(spark, sf):
    """How well each number alone orders the label, in either direction."""
    p = predictions(spark, sf).select("label", "p_model", "p_base", F.col("flag").cast("double").alias("flag"), (-F.col("p_base")).alias("turned"), F.when(F.col("l_linenumber") != 3, F.col("p_model")).alias("with_nulls"))
    return models.univariate(p, "label", ["p_model", "p_base", "flag", "turned", "with_nulls"]).select("feature", r6("auc").alias("auc"))


@query
def chosen_model(spark, sf):
    """The simplest of three models whose log loss is within 1 % of the best."""
    p = save(predictions(spark, sf).select("label", "p_base", "p_model", ((F.col("p_base") + F.col("p_model")) / 2).alias("p_mean")))
    order = ("p_base", "p_mean", "p_model")
    long = p.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("p")) for c in order])).alias("_x")).select("label", "_x.*")
    losses = save(metrics.scores(long, ["model"], "label", "p").select("model", "log_loss"))
    return losses.select("model", r6("log_loss").alias("log_loss"), (F.col("model") == models.select_model(losses, order)).alias("chosen"))


@query
def dropped_groups(spark, sf):
    """Each year left out once: log loss with all groups of columns and without each of them."""
    p = predictions(spark, sf).withColumn("year", F.floor((F.col("day") - 1) / 12).cast("int"))
    rows = save(p.select("year", "label", "p_model", "p_base", "priority"))
    groups = {"score": ["p_model"], "base": ["p_base"], "place": ["priority"]}
    make = lambda cs: models.Learner([c for c in cs if c != "priority"], [c for c in cs if c == "priority"])
    out = save(models.drop_one_group(rows, "label", "year", folds.leave_one_out(rows, "year"), groups, make))
    names = ["all", *[f"without {g}" for g in groups]]
    long = out.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("inputs"), F.col(c).alias("p")) for c in names])).alias("_x")).select("label", "_x.*")
    return metrics.scores(long, ["inputs"], "label", "p").select("inputs", "n", r6("log_loss").alias("log_loss"), r6("auc").alias("auc"))


@query
def calibrated_baselines(spark, sf):
    """The timetable model, calibrated over day blocks, one per cutoff, on the later half of the days."""
    rows = save(_dataset(spark, sf).where("eligible").select("cutoff_min", "planned_slack_min", F.to_date("pt_a").alias("day"), F.col("label_fail").cast("int").alias("label_fail")))
    middle = rows.agg(F.percentile_approx(F.datediff("day", F.lit("2000-01-01")), 0.5)).first()[0] or 0
    early = F.datediff("day", F.lit("2000-01-01")) <= middle
    per = models.PerCutoff(lambda: models.CalibratedModel(lambda: models.Learner(["planned_slack_min"]), "day"), CUTOFFS).fit(rows.where(early), "label_fail")
    return metrics.scores(per.predict(rows.where(~early)), ["cutoff_min"], "label_fail", "p").select("cutoff_min", "n", r6("fail_rate").alias("fail_rate"), r6("log_loss").alias("log_loss"))


# ---- reports


def _log(spark, sf) -> DataFrame:
    """One scored run per pair and cutoff at its cutoff time, with the features as they were logged: every ninth with a wrong slack."""
    d = _dataset(spark, sf)
    wrong = F.when(F.col("num_a").cast("long") % 9 == 0, F.col("db_slack_min") + 1).otherwise(F.col("db_slack_min"))
    return save(d.select("stop_id_a", "stop_id_b", F.col("t_cut").alias("scored_at"), "key_a", "key_b", "pt_a", "pt_b", "db_delay_a_min", "db_delay_b_min", wrong.alias("db_slack_min"), F.col("b_cancel_known").cast("double").alias("b_cancel_known")))


@query
def recomputed_skew(spark, sf):
    log = _log(spark, sf)
    again = monitor.recomputed(log, observations(spark, sf))
    out = monitor.skew(log, again, ["stop_id_a", "stop_id_b", "scored_at"], ["db_delay_a_min", "db_delay_b_min", "db_slack_min", "b_cancel_known"])
    return out.select("feature", "rows", r6("equal_share").alias("equal_share"), r6("mean_abs_diff").alias("mean_abs_diff"))


@query
def pooled_summary(spark, sf):
    joined = predictions(spark, sf).withColumn("outcome", F.when(F.col("l_linenumber") != 5, "evaluated").otherwise("excluded"))
    out = monitor.pooled(joined, "day", "cutoff_min", "label", "p_model", "p_base")
    return out.select("cutoff_min", "days", "rows", *[r6(c).alias(c) for c in ("fail_rate", "model_log_loss", "base_log_loss", "log_loss_gain", "log_loss_gain_low", "log_loss_gain_high", "auc_diff")])


@query
def daily_summary(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM"))
    reports = lines.groupBy("day").agg(F.count("*").alias("logged"))
    inputs = [F.struct(F.lit(c).alias("input"), F.abs(F.avg(c)).alias("psi")) for c in ("l_discount", "l_tax", "l_linenumber")]
    drift = lines.groupBy("day").agg(F.array(*inputs).alias("x")).select("day", F.explode("x").alias("x")).select("day", F.lit("all").alias("model"), "x.*", F.lit("ok").alias("status"))
    skews = lines.groupBy("day", "l_returnflag").agg(F.count("*").alias("rows"), F.avg((F.col("l_linestatus") == "O").cast("double")).alias("identical_share"))
    return monitor.summary_by_day(reports, drift, skews, ["l_linenumber"]).select("day", "logged", "max_psi_input", r6("max_psi").alias("max_psi"), r6("identical_share").alias("identical_share"))


@query
def complete_days(spark, sf):
    days = events(spark, sf).select(F.to_date("ts").alias("day")).distinct()
    newest = events(spark, sf).agg(F.max("ts").alias("last"))
    return days.crossJoin(F.broadcast(newest)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), labels.is_complete(F.col("last"), F.date_add("day", 1).cast("timestamp")).alias("complete"))


@query
def observability(spark, sf):
    c = save(_dataset(spark, sf).where("cutoff_min = 30").select("hub", "key_a", "key_b", "observed", "stale"))
    seen = observations(spark, sf).groupBy("key").agg(F.count("*").alias("n"))
    with_counts = c.join(seen.select(F.col("key").alias("key_a"), F.col("n").alias("na")), "key_a", "left").join(seen.select(F.col("key").alias("key_b"), F.col("n").alias("nb")), "key_b", "left")
    share = lambda x: r6(F.avg(F.col(x).cast("int"))).alias(x)
    with_counts = save(with_counts.select("hub", "observed", "stale", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb")))
    middle = quantiles.quantile_columns(with_counts, ["hub"], {"a": ("na", (0.5,)), "b": ("nb", (0.5,))}).select("hub", r6("a_p50").alias("median_a"), r6("b_p50").alias("median_b"))
    return quantiles.beside(with_counts.groupBy("hub").agg(F.count("*").alias("pairs"), share("observed"), share("stale")), middle, ["hub"])


@query
def failure_rates(spark, sf):
    """Failure rates by hub, by pair of segments, by hour and by slack bucket, in one pass over grouping sets."""
    d = _dataset(spark, sf).where("eligible").select("cutoff_min", "hub", F.concat_ws(">", "segment_a", "segment_b").alias("segments"), F.hour("pt_a").alias("hour"), F.floor(F.col("planned_slack_min") / 10).cast("int").alias("slack"), F.col("label_fail").cast("int").alias("fail"), (F.col("fail_reason") == "delay").cast("int").alias("late"))
    dims = ("hub", "segments", "hour", "slack")
    long = d.groupBy("cutoff_min", *dims).agg(F.count("*").alias("rows"), F.sum("fail").alias("fail"), F.sum("late").alias("late"))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dims])).alias("_x")
    out = long.select("cutoff_min", "rows", "fail", "late", values).groupBy("cutoff_min", "_x.dimension", "_x.value").agg(F.sum("rows").alias("rows"), F.sum("fail").alias("fail"), F.sum("late").alias("late"))
    return out.select("cutoff_min", "dimension", "value", "rows", r6(F.col("fail") / F.col("rows")).alias("fail_rate"), r6(F.col("late") / F.col("rows")).alias("delay_rate"))


@query
def slack_profile(spark, sf):
    j = _judged(spark, sf).where("passed")
    return profile.distribution(j, ["eva"], "slack_min", (0.05, 0.5, 0.95), exact=True).select("eva", "n", *[r6(c).alias(c) for c in ("mean", "p05", "p50", "p95")])


@query
def category_pairs(spark, sf):
    j = _judged(spark, sf).where("passed").withColumn("pair", F.concat_ws(">", "cat_a", "cat_b"))
    return profile.top_k(j, ["eva"], "pair", 5).select("eva", "pair", "n", "rank", r6("share").alias("share"))


@query
def feeder_coverage(spark, sf):
    feeders = table(spark, sf, "region").select(F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("name"))
    arrivals = plan(spark, sf).where("event = 'ar'").select("eva", "stop_id", F.explode_outer(path(F.col("path"))).alias("name"))
    hit = arrivals.join(feeders.withColumn("hit", F.lit(1)), "name", "left").groupBy("eva", "stop_id").agg(F.count("hit").alias("feeders"))
    return hit.groupBy("eva").agg(F.count("*").alias("arrivals"), r6(F.avg((F.col("feeders") > 0).cast("int"))).alias("covered"), r6(F.avg("feeders")).alias("feeders_each"))


def _feeders(spark, sf) -> DataFrame:
    """Arrivals with the same run's last click in the two days before, which stands for its event at a feeder."""
    p = plan(spark, sf)
    arrivals = p.where("event = 'ar'").select("stop_id", "trip", "eva", "pt", F.col("trip").cast("long").alias("key"))
    before = events(spark, sf).where("event_type = 'click'").select(F.col("user_id").cast("string").alias("_trip"), F.col("ts").alias("f_pt"), F.col("value").alias("f_delay_s"))
    both = arrivals.join(before, (F.col("trip") == F.col("_trip")) & (F.col("f_pt") < F.col("pt")) & (F.col("f_pt") >= F.col("pt") - F.expr("INTERVAL 2 DAYS")), "left")
    return both.groupBy("stop_id", "eva", "key", "pt").agg(F.max(F.struct("f_pt", "f_delay_s")).alias("f")).select("stop_id", "eva", "key", "pt", "f.*")


@query
def feeder_lead_times(spark, sf):
    f = save(_feeders(spark, sf)).withColumn("lead", minutes(F.col("pt"), F.col("f_pt")))
    passed = [r6(F.avg(F.coalesce(F.col("lead") >= c, F.lit(False)).cast("int"))).alias(f"passed_{c}") for c in CUTOFFS]
    leads = quantiles.exact_quantiles(f, ["eva"], "lead", (0.1, 0.5, 0.9)).select("eva", *[r6(F.col("quantiles")[i]).alias(f"p{q}") for i, q in enumerate((10, 50, 90))])
    return quantiles.beside(f.groupBy("eva").agg(F.count("*").alias("arrivals"), *passed), leads, ["eva"])


@query
def feeder_against_prognosis(spark, sf):
    from ..operators.asof import asof_join, last_state

    f = save(_feeders(spark, sf)).withColumn("t_cut", shifted(F.col("pt"), -30))
    obs = observations(spark, sf).select("key", "obs", "ct", "cs")
    known = asof_join(f, obs, ["key"], "t_cut", "obs", ["ct"], tie=["ct", "cs"])
    final = last_state(obs, ["key"], "obs", ["ct", "cs"]).select(F.col("key").alias("_k"), F.col("ct").alias("final"))
    rows = known.join(final, F.col("key") == F.col("_k")).select("eva", (F.col("f_delay_s") / 60).alias("feeder"), minutes(F.coalesce("ct", "pt"), F.col("pt")).alias("prognosis"), minutes(F.col("final"), F.col("pt")).alias("actual"))
    seen = rows.where("feeder IS NOT NULL")
    return seen.groupBy("eva").agg(F.count("*").alias("rows"), F.round(F.avg(F.abs(F.col("feeder") - F.col("actual"))), 3).alias("feeder_mae"), F.round(F.avg(F.abs(F.col("prognosis") - F.col("actual"))), 3).alias("prognosis_mae"), F.round(F.corr("feeder", "prognosis"), 4).alias("corr"))


@query
def poll_within_tolerance(spark, sf):
    """The last poll at most 15 minutes before the cutoff, joined to what that poll returned."""
    from ..operators.asof import last_time

    asked = events(spark, sf).where("event_type = 'purchase'").select("event_id", "eva", shifted(F.col("ts"), -30).alias("t_cut"))
    polls = events(spark, sf).where("event_type = 'click'").select("eva", F.col("ts").alias("t"), "value")
    near = last_time(asked, polls.select("eva", "t"), "eva", "t_cut", "t", "poll")
    near = near.withColumn("poll", F.when(minutes(F.col("t_cut"), F.col("poll")) <= 15, F.col("poll")))
    got = polls.groupBy(F.col("eva").alias("_e"), F.col("t").alias("_t")).agg(F.max("value").alias("value"))
    return near.join(got, (F.col("eva") == F.col("_e")) & (F.col("poll") == F.col("_t")), "left").select("event_id", micros("poll").alias("poll_us"), r6("value").alias("value"))


@query
def asof_of_one_key(spark, sf):
    """What was last seen anywhere before each purchase: one key for all rows, spread over its hours."""
    from ..operators.asof import asof_join_in_parts

    everything = F.lit("all").alias("everything")
    asked = events(spark, sf).where("event_type = 'purchase'").select("event_id", everything, shifted(F.col("ts"), -10).alias("t_cut"))
    seen = events(spark, sf).where("event_type <> 'purchase'").select(everything, F.col("ts").alias("seen_at"), F.col("event_id").alias("seen_id"), "event_type", "value")
    out = asof_join_in_parts(asked, seen, ["everything"], "t_cut", "seen_at", ["seen_id", "event_type", "value"], ["seen_id"])
    return out.select("event_id", micros("seen_at").alias("seen_us"), "seen_id", "event_type", r6("value").alias("value"))


@query
def message_flags(spark, sf):
    """Six message columns of each asked row: counts of three types and flags of three, in one pass."""
    from ..operators import features
    from .queries import _messages, _query_rows

    out = features.messages(_query_rows(spark, sf), _messages(spark, sf), "stop_id", "key", {"n_delay": "c", "n_quality": "e", "n_other": "v", "h": "h", "s": "s", "p": "p"})
    return out.select("stop_id", *[F.col(c).cast("long").alias(c) for c in ("n_delay", "n_quality", "n_other")], *[(F.col(c) > 0).alias(f"{c}_notice") for c in ("h", "s", "p")])


@query
def all_feature_groups(spark, sf):
    """One row per arrival and cutoff with every feature group that doesn't need a pair: hub, line, freshness, trend, messages, context, corridor."""
    from ..operators import features, grid
    from .queries import _grid, _messages

    obs = observations(spark, sf)
    rows = plan(spark, sf).where("event = 'ar'").select("eva", F.col("line").alias("line_a"), F.col("path").alias("path_a"), F.col("trip").cast("long").alias("key"), F.col("pt").alias("pt_a"), "first_seen", F.col("pp").alias("pp_a"), F.lit("1").alias("pp_b"), segment(F.col("cat")).alias("segment_a"), "stop_id", F.explode(F.array(*[F.lit(c) for c in CUTOFFS])).alias("cutoff_min"))
    rows = save(rows.withColumn("row", F.concat_ws(":", "stop_id", "cutoff_min")).withColumn("t_cut", shifted(F.col("pt_a"), -F.col("cutoff_min"))))
    g = save(_grid(spark, sf))
    hub, line = save(grid.hub_state(g)), save(grid.line_state(g))
    feeders = table(spark, sf, "region").select(F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_regionkey").cast("string").alias("eva"))
    out = grid.with_corridor(grid.with_hub_state(rows, hub, line), feeders, hub, line, "row", "path_a", F.col("first_seen") <= F.col("t_cut"))
    out = features.freshness(features.trend(out, obs, "row", "key", "pt_a"), obs, "key", "age_a_min")
    out = features.messages(out, _messages(spark, sf), "row", "key", {"n_delay_codes_a": "c", "n_quality_a": "e"})
    out = features.context(out)
    numbers = ("hub_share_cancel", "line_recent_delay_a", "corridor_delay_a", "age_a_min", "trend_a_15", "trend_a_30", "hour_sin")
    return out.select("stop_id", "cutoff_min", *[F.round(F.col(c), 4).alias(c) for c in numbers], F.col("n_delay_codes_a").cast("long").alias("n_delay_codes_a"), F.col("n_quality_a").cast("long").alias("n_quality_a"), "day_type", "same_platform")


def _connections(spark, sf) -> DataFrame:
    """All candidates, half an hour before they arrive."""
    c = _candidates(spark, sf).withColumn("key_a", F.col("trip_a").cast("long")).withColumn("key_b", F.col("trip_b").cast("long"))
    return save(c.withColumn("row", F.concat_ws("|", "eva", "stop_id_a", "stop_id_b")).withColumn("t_cut", shifted(F.col("pt_a"), -30)))


def _all_features(spark, sf, rows: DataFrame) -> DataFrame:
    """Every feature of connections at their t_cut. Clicks stand for delay codes, errors for quality codes; every fourth and sixth stop has a notice."""
    g = save(_grid(spark, sf))
    hub, line = save(grid.hub_state(g)), save(grid.line_state(g))
    feeders = table(spark, sf, "region").select(F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_regionkey").cast("string").alias("eva"))
    of_events = _messages(spark, sf).select("key", F.when(F.col("type") == "c", "d").when(F.col("type") == "e", "q").alias("type"), "obs")
    n = F.col("event_id")
    kinds = F.filter(F.array(F.when(n % 4 == 0, "h"), F.when(n % 6 == 0, "c")), lambda x: x.isNotNull())
    of_stops = events(spark, sf).select(F.concat(n.cast("string"), F.lit("-1")).alias("stop_id"), F.explode(kinds).alias("type"), shifted(F.col("ts"), -(n % 90)).alias("obs"))
    return offline.all_features(rows, plan(spark, sf), observations(spark, sf), of_events, of_stops, feeders, hub, line, holidays=("2024-01-01",))


@query
def connection_features(spark, sf):
    """Every feature of every candidate, half an hour before it arrives."""
    from ..operators.features import GROUPS, feature_columns

    out = _all_features(spark, sf, _connections(spark, sf))
    whole = ("n_stations_before_a", "same_platform", *offline.MESSAGES)
    text = ("day_type", "segment_a", "segment_b", "hub", "b_cancel_known")
    shown = [F.col(c) if c in text else F.col(c).cast("long").alias(c) if c in whole else (F.round(c, 4) + 0.0).alias(c) for c in feature_columns(list(GROUPS))]
    return out.select("row", *shown)


@query
def skew_of_all_features(spark, sf):
    """Logged features against those of the stored data: every ninth row was logged with two minutes too much slack, every seventh with another segment."""
    from ..operators.features import GROUPS, feature_columns

    rows = _connections(spark, sf)
    again = save(_all_features(spark, sf, rows))
    n = F.regexp_extract("row", r"([0-9]+)-1[|]", 1).cast("long")
    log = again.withColumn("planned_slack_min", F.when(n % 9 == 0, F.col("planned_slack_min") + 2).otherwise(F.col("planned_slack_min"))).withColumn("segment_a", F.when(n % 7 == 0, "another").otherwise(F.col("segment_a")))
    out = monitor.skew(log, again, ["row"], feature_columns(list(GROUPS)))
    return out.select("feature", "rows", r6("equal_share").alias("equal_share"), r6("mean_abs_diff_where_different").alias("mean_abs_diff_where_different"))


@query
def matched_runs(spark, sf):
    """How many arrivals have the same run at the same hub, where a departing event is preferred to an arriving one; the other side knows no buses."""
    p = plan(spark, sf)
    best = profile.preferred(p.where("cat <> 'Bus'"), ["eva", "trip"], F.when(F.col("event") == "dp", 0).otherwise(1), ["pt", "stop_id", "event"]).select("eva", "trip", F.col("event").alias("matched_event"))
    rows = p.where("event = 'ar'").select("eva", "trip").join(best, ["eva", "trip"], "left")
    return rows.groupBy("eva").agg(F.count("*").alias("arrivals"), r6(F.avg(F.col("matched_event").isNotNull().cast("int"))).alias("match_rate"), r6(F.avg((F.col("matched_event") == "dp").cast("int"))).alias("departing"))


@query
def named_suppliers(spark, sf):
    """The twenty busiest suppliers whose name holds a 1, with their lines per active day and mean quantity."""
    names = table(spark, sf, "supplier").where(F.col("s_name").ilike("%SUPPLIER%1%")).select("s_suppkey", "s_name")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.count_distinct(F.to_date("l_shipdate")).alias("days"), F.avg("l_quantity").alias("quantity"))
    return names.join(lines, "s_suppkey").select("s_suppkey", "s_name", "lines", r6(F.col("lines") / F.col("days")).alias("lines_per_day"), r6("quantity").alias("quantity")).orderBy(F.desc("lines"), "s_suppkey").limit(20)


@query
def cancellation_shares(spark, sf):
    is_type = lambda t: F.col("event_type") == t
    e = events(spark, sf).withColumn("hour", F.hour("ts"))
    out = profile.shares_of(e, ["eva", "hour"], {"cancelled": is_type("error"), "replaced": is_type("signup"), "late": F.when(~is_type("error"), F.col("value") > 60)})
    return out.select("eva", "hour", "rows", *[r6(c).alias(c) for c in ("cancelled", "replaced", "late")])


@query
def hub_period_summary(spark, sf):
    d = _dataset(spark, sf).where("eligible").select("hub", "cutoff_min", F.weekofyear("pt_a").alias("week"), F.col("label_fail").cast("int").alias("fail"), "planned_slack_min")
    return d.groupBy("hub", "cutoff_min", "week").agg(F.count("*").alias("rows"), r6(F.avg("fail")).alias("fail_rate"), r6(F.avg("planned_slack_min")).alias("mean_slack"))


@query
def gains_per_day_and_slice(spark, sf):
    """Gains by day and priority, a row each."""
    gains = metrics.gains_by(predictions(spark, sf), ["day", "priority"], "label", "p_model", "p_base")
    return gains.select("day", "priority", "rows", r6("gain").alias("gain"))
