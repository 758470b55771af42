"""Labels, exclusion reasons and the training table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import minutes, service_day, shifted
from ..sources.scratch import save
from .asof import asof_join, last_state, last_time
from .metrics import auc

#: The first reason that holds, in this order, is a row's exclusion reason.
EXCLUSIONS = ("not_known_at_cutoff", "collector_gap", "a_cancelled_at_cutoff", "unobserved", "stale_label", "dst_ambiguous")
#: The five classes of columns of the training table; every column is in one. Inputs come from `planned` and `at_cutoff` alone.
USAGE = {
    "key": ("service_day", "cutoff_min", "t_cut", "eva", "hub", "stop_id_a", "stop_id_b", "trip_a", "trip_b", "key_a", "key_b"),
    "planned": ("pt_a", "pt_b", "planned_slack_min", "cat_a", "cat_b", "num_a", "num_b", "line_a", "line_b", "segment_a", "segment_b", "pp_a", "pp_b", "origin_a", "prev_station_a", "n_stations_before_a", "next_station_b", "destination_b", "n_stations_after_b", "path_a", "path_b"),
    "at_cutoff": ("a_ct_cut", "a_cs_cut", "a_obs_cut", "b_ct_cut", "b_cs_cut", "b_obs_cut", "db_delay_a_min", "db_delay_b_min", "db_slack_min", "b_cancel_known", "collector_age_min"),
    "label": ("a_ct_final", "a_cs_final", "a_obs_final", "b_ct_final", "b_cs_final", "b_obs_final", "delay_a_final_min", "delay_b_final_min", "real_slack_min", "label_fail", "fail_reason", "observed", "stale"),
    "quality": ("first_seen_a", "first_seen_b", "exclusion_reason", "eligible"),
}
FEATURE_SAFE = ("planned", "at_cutoff")


def first_reason(conditions: dict[str, Column]) -> Column:
    """The name of the first condition that holds; unknown counts as not holding; null if none does."""
    items = list(conditions.items())
    out = F.when(F.coalesce(items[0][1], F.lit(False)), items[0][0])
    for name, c in items[1:]:
        out = out.when(F.coalesce(c, F.lit(False)), name)
    return out


def with_labels(pairs: DataFrame, obs: DataFrame, min_transfer: float = 4.0) -> DataFrame:
    """Adds final states and the label: cancelled on either side, or too little real time to change.

    pairs: key_a, key_b, pt_a, pt_b. obs: key, obs, ct, cs. Missing times make no delay failure. The final states are
    written first, so that Spark knows their size and need not shuffle the pairs when they are few.
    """
    final = save(last_state(obs, ["key"], "obs", ["ct", "cs"]))
    out = pairs
    for side in ("a", "b"):
        renamed = final.select(F.col("key").alias("_k"), *[F.col(c).alias(f"{side}_{c}_final") for c in ("obs", "ct", "cs")])
        out = out.join(renamed, F.col(f"key_{side}") == F.col("_k"), "left").drop("_k")
    gone = {s: F.coalesce(F.col(f"{s}_cs_final") == "c", F.lit(False)) for s in "ab"}
    real = minutes(F.col("b_ct_final"), F.col("a_ct_final"))
    late = F.coalesce(real < min_transfer, F.lit(False))
    seen = lambda s: F.col(f"{s}_ct_final").isNotNull() | gone[s]
    stale = lambda s: F.coalesce(~gone[s] & (F.col(f"{s}_obs_final") < F.col(f"{s}_ct_final")), F.lit(False))
    return out.select(
        "*",
        minutes(F.col("a_ct_final"), F.col("pt_a")).alias("delay_a_final_min"),
        minutes(F.col("b_ct_final"), F.col("pt_b")).alias("delay_b_final_min"),
        real.alias("real_slack_min"),
        (gone["a"] | gone["b"] | late).alias("label_fail"),
        F.coalesce(first_reason({"a_cancelled": gone["a"], "b_cancelled": gone["b"], "delay": late}), F.lit("none")).alias("fail_reason"),
        (seen("a") & seen("b")).alias("observed"),
        (stale("a") | stale("b")).alias("stale"),
    )


def at_cutoffs(pairs: DataFrame, obs: DataFrame, polls: DataFrame, cutoffs: Sequence[int] = (60, 30, 10), max_gap: float = 45.0, ambiguous: Column | None = None) -> DataFrame:
    """One row per pair and cutoff with what was known then, and the first reason to exclude it.

    What an arrival and its hub's polls tell is found once for each arrival, not for each of its pairs; what is known of a
    departure once for each time of its arrivals, however many of them share it. Pairs travel once for either, and
    become a row per cutoff last. pairs: labelled, with eva, stop_id_a (which name an arrival) and first_seen_a/b, read
    three times. polls: eva, t.
    """
    facts = obs.select(F.col("key").alias("_key"), "obs", "ct", "cs")
    cuts = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(c).alias("cutoff_min")) for i, c in enumerate(cutoffs)])).alias("_c")
    ask = lambda df, *names: df.select(*names, cuts).select(*names, "_c.*").withColumn("t_cut", shifted(F.col("pt_a"), -F.col("cutoff_min")))
    know = lambda df: asof_join(df, facts, ["_key"], "t_cut", "obs", ["ct", "cs"], tie=["ct", "cs"])
    wide = lambda of: [F.max(F.when(F.col("_i") == i, F.struct(*of))).alias(f"_{of[-1]}{i}") for i in range(len(cutoffs))]
    arrivals = ask(pairs.select("eva", "stop_id_a", F.col("key_a").alias("_key"), "pt_a").distinct(), "eva", "stop_id_a", "_key", "pt_a")
    polled = last_time(know(arrivals), polls, "eva", "t_cut", "t", "poll").withColumn("a", F.lit("a"))
    polled = polled.groupBy(*[F.col(c).alias(f"_{c}") for c in ("eva", "stop_id_a", "pt_a")], F.col("_key").alias("_key_a")).agg(*wide(["t_cut", "obs", "ct", "cs", "poll", "a"]))
    departing = know(ask(pairs.select(F.col("key_b").alias("_key"), "pt_a").distinct(), "_key", "pt_a")).withColumn("b", F.lit("b"))
    left = departing.groupBy(F.col("_key").alias("_key_b"), F.col("pt_a").alias("_pt_b")).agg(*wide(["obs", "ct", "cs", "b"]))
    same = F.col("key_b").eqNullSafe(F.col("_key_b")) & F.col("pt_a").eqNullSafe(F.col("_pt_b"))
    on = (F.col("eva") == F.col("_eva")) & (F.col("stop_id_a") == F.col("_stop_id_a")) & F.col("key_a").eqNullSafe(F.col("_key_a")) & F.col("pt_a").eqNullSafe(F.col("_pt_a"))
    met = pairs.join(left, same).join(polled, on)
    each = [F.struct(F.lit(c).alias("cutoff_min"), F.col(f"_a{i}").alias("a"), F.col(f"_b{i}").alias("b")) for i, c in enumerate(cutoffs)]
    states = [F.col(f"_x.{x}.{c}").alias(f"{x}_{c}_cut") for x in "ab" for c in ("obs", "ct", "cs")]
    rows = met.select(*pairs.columns, F.explode(F.array(*each)).alias("_x")).select(*pairs.columns, "_x.cutoff_min", "_x.a.t_cut", *states, F.col("_x.a.poll").alias("_poll"))
    a, b = F.coalesce("a_ct_cut", "pt_a"), F.coalesce("b_ct_cut", "pt_b")
    rows = rows.select(
        "*",
        minutes(a, F.col("pt_a")).alias("db_delay_a_min"),
        minutes(b, F.col("pt_b")).alias("db_delay_b_min"),
        minutes(b, a).alias("db_slack_min"),
        F.coalesce(F.col("b_cs_cut") == "c", F.lit(False)).alias("b_cancel_known"),
        minutes(F.col("t_cut"), F.col("_poll")).alias("collector_age_min"),
    )
    reason = first_reason(
        dict(
            zip(
                EXCLUSIONS,
                (
                    (F.col("first_seen_a") > F.col("t_cut")) | (F.col("first_seen_b") > F.col("t_cut")),
                    F.col("_poll").isNull() | (F.col("collector_age_min") > max_gap),
                    F.col("a_cs_cut") == "c",
                    ~F.col("observed"),
                    F.col("stale"),
                    F.lit(False) if ambiguous is None else ambiguous,
                ),
                strict=True,
            )
        )
    )
    return rows.withColumn("exclusion_reason", reason).withColumn("eligible", F.col("exclusion_reason").isNull()).drop("_poll")


def summary(rows: DataFrame) -> DataFrame:
    """Per cutoff: rows, eligible rows, failures in percent, AUC of the planned and of the predicted slack; the columns that this takes are written once."""
    rows = save(rows.select("cutoff_min", "eligible", "label_fail", "planned_slack_min", "db_slack_min", "b_cancel_known"))
    counts = rows.groupBy("cutoff_min").agg(F.count("*").alias("rows"), F.count_if("eligible").alias("eligible"), F.round(100 * F.avg(F.when(F.col("eligible"), F.col("label_fail").cast("int"))), 4).alias("fail_pct"))
    known = F.when(F.col("b_cancel_known"), F.lit(1e9)).otherwise(-F.col("db_slack_min"))
    scored = rows.where("eligible").select("cutoff_min", "label_fail", (-F.col("planned_slack_min")).alias("planned"), known.alias("predicted"))
    for name in ("planned", "predicted"):
        counts = counts.join(auc(scored, ["cutoff_min"], "label_fail", name, f"auc_{name}"), "cutoff_min", "left")
    return counts


def exclusions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cutoff_min", F.coalesce("exclusion_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("rows"))


def is_complete(newest: Column, end: Column, horizon_h: int = 6) -> Column:
    """Whether the data reach `horizon_h` hours past the end of a day; without data they don't."""
    return F.coalesce(newest >= end + F.expr(f"INTERVAL {horizon_h} HOURS"), F.lit(False))


def usage_columns(*kinds: str) -> list[str]:
    """Columns of the training table by use; an unknown use is an error."""
    unknown = set(kinds) - set(USAGE)
    if unknown:
        raise ValueError(f"no such use of columns: {sorted(unknown)}")
    return [c for k in kinds for c in USAGE[k]]


def training_table(rows: DataFrame) -> DataFrame:
    """at_cutoffs' rows with their service day, in the order of the classes; a column in no class, or one that lacks, is an error."""
    out = rows.withColumn("service_day", service_day(F.col("pt_a")))
    wanted = usage_columns(*USAGE)
    if wrong := set(out.columns) ^ set(wanted):
        raise ValueError(f"columns without a use, or uses without a column: {sorted(wrong)}")
    return out.select(*wanted)


def feature_safe(table: DataFrame) -> DataFrame:
    """Keys and what was known by the cutoff: nothing else may be an input."""
    return table.select(*usage_columns("key", *FEATURE_SAFE))
