"""Predictions against outcomes: evaluation, operations, skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import minutes
from ..sources.scratch import save
from .asof import asof_join
from .metrics import bootstrap_gain, collapsed, flag_metrics, recall_at_precision, scores
from .quantiles import beside, quantile_columns


def first_logged(log: DataFrame, key: Sequence[str], time: str, parts: int | None = None) -> DataFrame:
    """The first logged row of each key; rows equal in time are ordered by their other columns.

    With `parts` rows are dealt to so many parts by key before they are compared, so that no task sorts more than a part:
    for logs whose keys repeat little, of which a first comparison inside each task would drop next to nothing.
    """
    rest = [c for c in log.columns if c not in key and c != time]
    best = F.min(F.struct(time, *rest)).alias("_m")
    if parts is not None:
        log = log.repartition(parts, *key)
    return log.groupBy(*key).agg(best).select(*key, "_m.*").select(*log.columns)


def outcomes(predictions: DataFrame, labelled: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictions with their labels and class: evaluated, excluded, or not_a_candidate."""
    marked = labelled.withColumn("_there", F.lit(True))
    joined = predictions.join(marked, list(key), "left")
    kind = F.when(F.col("_there").isNull(), "not_a_candidate").when(F.coalesce("eligible", F.lit(False)), "evaluated").otherwise("excluded")
    return joined.withColumn("outcome", kind).drop("_there")


def operations(joined: DataFrame, groups: Sequence[str], lag: str, age: str, exact: bool = False) -> DataFrame:
    """Outcome counts, share evaluated, and quantiles of lag and data age, to within a rank of 1 in 10,000 unless `exact`."""
    at = (0.5, 0.95)
    q = [] if exact else [F.percentile_approx(c, p, 10_000).alias(f"{c}_p{round(p * 100)}") for c in (lag, age) for p in at]
    kinds = [F.count_if(F.col("outcome") == k).alias(k) for k in ("evaluated", "excluded", "not_a_candidate")]
    if exact:
        joined = save(joined.select(*groups, "outcome", lag, age))
    out = joined.groupBy(*groups).agg(F.count("*").alias("predictions"), *kinds, F.avg((F.col("outcome") == "evaluated").cast("double")).alias("coverage"), *q, F.max(lag).alias(f"{lag}_max"), F.max(age).alias(f"{age}_max"))
    return beside(out, quantile_columns(joined, groups, {lag: (lag, at), age: (age, at)}), groups) if exact else out


def performance(joined: DataFrame, groups: Sequence[str], label: str, model: str, base: str, rule: str) -> DataFrame:
    """Scores of model and base, the rule's precision and recall, the gain, and the model's recall at the rule's precision."""
    rows, c = collapsed(joined.where(F.col("outcome") == "evaluated"), [*groups, label, model, base, rule]), F.col("_c")
    names = ("n", "fail_rate", "mean_p", "log_loss", "brier", "auc")
    m = scores(rows, groups, label, model, c).select(*groups, *[F.col(c).alias(f"model_{c}") for c in names])
    b = scores(rows, groups, label, base, c).select(*groups, F.col("log_loss").alias("base_log_loss"), F.col("auc").alias("base_auc"))
    r = flag_metrics(rows, groups, label, rule, c).select(*groups, F.col("precision").alias("rule_precision"), F.col("recall").alias("rule_recall"))
    goal = rows.join(r.select(*groups, "rule_precision"), list(groups))
    at = recall_at_precision(goal, groups, label, model, "rule_precision", c).select(*groups, F.col("recall").alias("recall_at_rule_precision"), "threshold")
    out = m.join(b, list(groups)).join(r, list(groups)).join(at, list(groups), "left")
    return out.withColumn("gain", 1 - F.col("model_log_loss") / F.col("base_log_loss"))


def skew(live: DataFrame, offline: DataFrame, key: Sequence[str], features: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per feature: rows compared, share equal (nulls and NaN equal themselves), mean absolute difference of all rows with both
    numbers, and of those that are not equal; and `<row>`: shares of rows equal in all. Features that are text on either
    side are compared as text and have no difference.
    """
    text = {c for c in features for df in (live, offline) if df.schema[c].dataType.typeName() == "string"}
    side = lambda df, x: df.select(*key, *[F.col(c).cast("string" if c in text else "double").alias(f"_{x}{i}") for i, c in enumerate(features)])
    pairs = side(live, "l").join(side(offline, "o"), list(key))
    clean = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    none = F.lit(None).cast("double")
    items, all_equal = [], F.lit(True)
    for i, c in enumerate(features):
        if c in text:
            equal, diff = F.col(f"_l{i}").eqNullSafe(F.col(f"_o{i}")), none
        else:
            a, b = clean(f"_l{i}"), clean(f"_o{i}")
            equal, diff = F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance), F.abs(a - b)
        all_equal = all_equal & equal
        items.append(F.struct(F.lit(c).alias("feature"), equal.alias("equal"), diff.alias("diff")))
    items.append(F.struct(F.lit("<row>").alias("feature"), all_equal.alias("equal"), none.alias("diff")))
    long = pairs.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")
    differing = F.avg(F.when(~F.col("equal"), F.col("diff")))
    return long.groupBy("feature").agg(F.count("*").alias("rows"), F.avg(F.col("equal").cast("double")).alias("equal_share"), F.avg("diff").alias("mean_abs_diff"), differing.alias("mean_abs_diff_where_different"))


def recomputed(log: DataFrame, obs: DataFrame) -> DataFrame:
    """The log's key columns with the features as the stored observations give them for each row's scored_at.

    log: stop_id_a, stop_id_b, scored_at, key_a, key_b, pt_a, pt_b. obs: key, obs, ct, cs. The same as-of joins as for
    training, with scored_at as the cutoff; rows logged at any time go through them together.
    """
    out = log
    for side in ("a", "b"):
        facts = obs.select(F.col("key").alias(f"key_{side}"), F.col("obs").alias(f"{side}_obs_cut"), F.col("ct").alias(f"{side}_ct_cut"), F.col("cs").alias(f"{side}_cs_cut"))
        out = asof_join(out, facts, [f"key_{side}"], "scored_at", f"{side}_obs_cut", [f"{side}_ct_cut", f"{side}_cs_cut"], tie=[f"{side}_ct_cut", f"{side}_cs_cut"])
    a, b = F.coalesce("a_ct_cut", "pt_a"), F.coalesce("b_ct_cut", "pt_b")
    return out.select(
        "stop_id_a", "stop_id_b", "scored_at", minutes(a, F.col("pt_a")).alias("db_delay_a_min"), minutes(b, F.col("pt_b")).alias("db_delay_b_min"),
        minutes(b, a).alias("db_slack_min"), F.coalesce(F.col("b_cs_cut") == "c", F.lit(False)).cast("double").alias("b_cancel_known"),
    )


def pooled(joined: DataFrame, day: str, cutoff: str, label: str, model: str, base: str, draws: int = 1000, auc_draws: int = 200, seed: int = 0) -> DataFrame:
    """Model against base over the evaluated rows of all days, by cutoff, with intervals over whole days."""
    rows, c = collapsed(joined.where(F.col("outcome") == "evaluated"), [cutoff, day, label, model, base]), F.col("_c")
    losses = scores(rows, [cutoff], label, model, c).select(cutoff, "fail_rate", F.col("log_loss").alias("model_log_loss")).join(scores(rows, [cutoff], label, base, c).select(cutoff, F.col("log_loss").alias("base_log_loss")), cutoff)
    gain = bootstrap_gain(rows, day, label, model, base, draws, auc_draws, seed, [cutoff], "_c")
    return losses.join(gain, cutoff).select(cutoff, "days", "rows", "fail_rate", "model_log_loss", "base_log_loss", "log_loss_gain", "log_loss_gain_low", "log_loss_gain_high", "auc_diff", "auc_diff_low", "auc_diff_high")


def summary_by_day(reports: DataFrame, drift: DataFrame, skews: DataFrame, day_constant: Sequence[str] = ()) -> DataFrame:
    """reports (one row a day) with the input that drifted most that day and the share of rows without skew.

    drift: day, model, input, psi, status. Inputs that are one value on a whole day (day_constant) differ from any mix of
    days by nature and are no drift. skews: day, rows, identical_share for each part; parts weigh by rows.
    """
    real = drift.where((F.col("status") == "ok") & F.col("psi").isNotNull())
    if day_constant:
        real = real.where(~F.col("input").isin(*day_constant))
    top = worst(real, ["day"], "input", "psi").select(F.col("day").alias("_d1"), F.col("input").alias("max_psi_input"), F.col("psi").alias("max_psi"))
    same = skews.where("rows > 0").groupBy(F.col("day").alias("_d2")).agg((F.sum(F.col("rows") * F.col("identical_share")) / F.sum("rows")).alias("identical_share"))
    return reports.join(top, F.col("day") == F.col("_d1"), "left").join(same, F.col("day") == F.col("_d2"), "left").drop("_d1", "_d2")


def missing_days(rows: DataFrame, day: str) -> DataFrame:
    """The days between the first and the last one that have no row."""
    span = rows.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return span.join(rows.select(F.col(day).alias("_d")).distinct(), F.col("day") == F.col("_d"), "left_anti")


def finished_days(days: DataFrame, reports: DataFrame, data_end: Column, horizon_h: int = 6) -> DataFrame:
    """Days (day, day_end) whose label horizon the data have passed and that no report covers yet."""
    ended = days.where(F.col("day_end") + F.expr(f"INTERVAL {horizon_h} HOURS") <= data_end)
    return ended.join(reports.select("day").distinct(), "day", "left_anti")


def worst(rows: DataFrame, group: Sequence[str], name: str, value: str) -> DataFrame:
    """The row with the highest value per group; of equal ones the first by name."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc_nulls_last(), name)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*group, name, value)
