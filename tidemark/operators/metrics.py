"""Evaluation metrics as aggregate queries, without a sort of all rows in one place."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import save
from . import bootstrap

EPS = 1e-6
#: Scores are laid out in so many value ranges before prefix sums; only the ranges' totals meet.
RANGES = 64


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))


def log_loss(y: Column, p: Column) -> Column:
    q = clipped(p)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def logit(p: Column) -> Column:
    q = clipped(p)
    return F.ln(q / (1 - q))


def _beside(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the columns of right, which has one row for each value of `on`; nulls equal nulls."""
    renamed = right.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    if not on:
        return left.crossJoin(F.broadcast(renamed))
    names = [f"_on{i}" for i in range(len(on))]
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(on, names, strict=True)], how).drop(*names)


def collapsed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each different row of the columns once, with its count as `_c`: written once, so that nothing below makes the rows again.

    Figures of labels and scores depend on nothing else. Where all rows differ this costs one shuffle of the columns.
    """
    return save(rows.groupBy(*dict.fromkeys(columns)).agg(F.count("*").alias("_c")))


def _by_score(rows: DataFrame, groups: Sequence[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """(groups, score, pos, neg) with `below_pos`, `below_neg`: totals of the smaller scores of the group.

    Rows collapse to one per score first. Scores are dealt to ranges that hold about as many different
    scores each; sums run inside a range, and ranges are joined with the totals of those before them.
    """
    w = F.lit(1) if weight is None else weight
    y = F.col(label).cast("int")
    counts = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*groups, F.col(score).cast("double").alias("_s")).agg(F.sum(y * w).alias("pos"), F.sum((1 - y) * w).alias("neg"))
    cuts = counts.groupBy(*groups).agg(F.percentile_approx("_s", [k / RANGES for k in range(1, RANGES)], 20 * RANGES).alias("_cuts"))
    joined = _beside(counts, cuts, groups)
    counts = joined.withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("_s")))).drop("_cuts")
    inside = Window.partitionBy(*groups, "_r").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*groups).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*groups, "_r").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select(*groups, "_r", zero(F.sum("_p").over(before)).alias("_bp"), zero(F.sum("_n").over(before)).alias("_bn"))
    out = counts.select("*", zero(F.sum("pos").over(inside)).alias("_ip"), zero(F.sum("neg").over(inside)).alias("_in"))
    return _beside(out, totals, [*groups, "_r"]).select(*groups, F.col("_s").alias("score"), "pos", "neg", (F.col("_ip") + F.col("_bp")).alias("below_pos"), (F.col("_in") + F.col("_bn")).alias("below_neg"))


def auc(rows: DataFrame, groups: Sequence[str], label: str, score: str, out: str = "auc", weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums, ties averaged; null where a group has one class only."""
    s = _by_score(rows, groups, label, score, weight)
    wins = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    return s.groupBy(*groups).agg(F.try_divide(wins.cast("double"), (F.sum("pos") * F.sum("neg")).cast("double")).alias(out))


def flag_metrics(rows: DataFrame, groups: Sequence[str], label: str, flag: str, weight: Column | None = None) -> DataFrame:
    """Precision, recall and false alarms of a flag; null where undefined."""
    y, f = F.col(label).cast("int") == 1, F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    n = lambda c: (F.count_if(c) if weight is None else F.sum(F.when(c, weight).otherwise(0))).cast("double")
    share = lambda a, b: F.try_divide(n(a), n(b))
    return rows.groupBy(*groups).agg(share(f & y, f).alias("precision"), share(f & y, y).alias("recall"), share(f & ~y, ~y).alias("false_alarms"))


def recall_at_precision(rows: DataFrame, groups: Sequence[str], label: str, score: str, target: float | str, weight: Column | None = None) -> DataFrame:
    """The highest recall with a precision of at least `target`, and the lowest threshold that gives it.

    `target` is a number or a column of the groups' rows. No positives, or no threshold that precise: nulls.
    """
    s = _by_score(rows, groups, label, score, weight)
    totals = s.groupBy(*groups).agg(F.sum("pos").alias("_all_pos"), F.sum("neg").alias("_all_neg"))
    s = _beside(s, totals, groups)
    if isinstance(target, float):
        s = s.withColumn("_goal", F.lit(target))
    else:
        goals = rows.groupBy(*groups).agg(F.max(target).alias("_goal"))
        s = _beside(s, goals, groups)
    tp, fp = F.col("_all_pos") - F.col("below_pos"), F.col("_all_neg") - F.col("below_neg")
    s = s.withColumn("_p", tp / (tp + fp)).withColumn("_recall", F.try_divide(tp, F.col("_all_pos")))
    best = F.max(F.when((F.col("_p") >= F.col("_goal")) & (F.col("_all_pos") > 0), F.struct("_recall", (-F.col("score")).alias("_low"))))
    return s.groupBy(*groups).agg(best.alias("_m")).select(*groups, F.col("_m._recall").alias("recall"), (-F.col("_m._low")).alias("threshold"))


def decision_layer(rows: DataFrame, groups: Sequence[str], label: str, score: str, flag: str) -> DataFrame:
    """The threshold at which a score is as precise as a flag, and the shares of rows it then gets right and wrong.

    Returns groups, precision (the flag's), threshold, recall, and the shares hit, false_alarm, missed and
    quiet, which sum to 1. Groups in which no threshold is that precise have null shares.
    """
    on = list(groups)
    rule = flag_metrics(rows, groups, label, flag).select(*on, "precision")
    aimed = _beside(rows, rule, on)
    at = recall_at_precision(aimed, groups, label, score, "precision")
    cut = _beside(aimed, at, on)
    y, f = F.col(label).cast("int") == 1, F.col(score) >= F.col("threshold")
    share = lambda c: F.avg(F.when(F.col("threshold").isNotNull(), c.cast("double")))
    return cut.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*on, "precision", "threshold", "recall").agg(share(f & y).alias("hit"), share(f & ~y).alias("false_alarm"), share(~f & y).alias("missed"), share(~f & ~y).alias("quiet"))


def scores(rows: DataFrame, groups: Sequence[str], label: str, p: str, weight: Column | None = None) -> DataFrame:
    """n, failure rate, mean prediction, log loss, Brier score and AUC; the last and log loss are null for 0/1 rules."""
    y, q = F.col(label).cast("double"), F.col(p)
    rows = rows.where(y.isNotNull() & q.isNotNull())
    rule = F.every(q.isin(0.0, 1.0))
    n = F.count("*") if weight is None else F.sum(weight)
    mean = lambda x: F.avg(x) if weight is None else F.try_divide(F.sum(x * weight), n)
    point = rows.groupBy(*groups).agg(
        n.alias("n"), mean(y).alias("fail_rate"), mean(q).alias("mean_p"), F.when(~rule, mean(log_loss(y, q))).alias("log_loss"), mean((q - y) * (q - y)).alias("brier"), rule.alias("_rule")
    )
    area = auc(rows, groups, label, p, weight=weight)
    both = _beside(point, area, groups, "left")
    return both.withColumn("auc", F.when(~F.col("_rule"), F.col("auc"))).drop("_rule")


def metric_table(rows: DataFrame, label: str, models: Sequence[str], cutoff: str, slices: Sequence[str]) -> DataFrame:
    """Scores of every model by cutoff, overall and for each value of each slice column, in long form.

    Rows first shrink to counts by (cutoff, slice values, label, model, prediction); only those are listed under
    each slice, so the rows themselves are never multiplied. Columns as in scores().
    """
    m = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models])).alias("_m")
    y = F.col(label).cast("int")
    counts = rows.where(y.isNotNull()).select(cutoff, y.alias("_y"), *slices, m).where("_m.p IS NOT NULL").groupBy(cutoff, *slices, "_y", "_m.model", "_m.p").agg(F.count("*").alias("_c"))
    values = [F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in slices]]
    long = counts.select(cutoff, "_y", "model", "p", "_c", F.explode(F.array(*values)).alias("_x")).groupBy(cutoff, "_x.slice", "_x.value", "model", "_y", "p").agg(F.sum("_c").alias("_c"))
    groups, c, p = [cutoff, "slice", "value", "model"], F.col("_c"), F.col("p")
    mean = lambda x: F.sum(x * c) / F.sum(c)
    point = long.groupBy(*groups).agg(
        F.sum(c).alias("n"), mean(F.col("_y")).alias("fail_rate"), mean(p).alias("mean_p"), mean(log_loss(F.col("_y"), p)).alias("log_loss"), mean((p - F.col("_y")) * (p - F.col("_y"))).alias("brier"), F.every(p.isin(0.0, 1.0)).alias("_rule")
    )
    area = auc(long, groups, "_y", "p", weight=c)
    both = _beside(point, area, groups, "left")
    return both.withColumn("log_loss", F.when(~F.col("_rule"), F.col("log_loss"))).withColumn("auc", F.when(~F.col("_rule"), F.col("auc"))).drop("_rule")


def reliability(rows: DataFrame, groups: Sequence[str], label: str, p: str, bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate in bins of equal width; the last one holds 1."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(p).isNotNull()).groupBy(*groups, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("observed"))


def per_day(rows: DataFrame, day: str, label: str, models: Sequence[str]) -> DataFrame:
    y = F.col(label).cast("double")
    return rows.groupBy(day).agg(F.count("*").alias("n"), *[F.avg(log_loss(y, F.col(m))).alias(m) for m in models])


def bootstrap_gain(rows: DataFrame, day: str, label: str, model: str, base: str, draws: int = 1000, auc_draws: int = 200, seed: int = 0, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Relative log-loss and Brier gains of a model over a base, and its AUC lead, with 95 % intervals over whole days.

    Rows collapse to different ones with their counts, unless they come so with the column `weight`. These shrink to sums per day, and for the AUC to counts per day and score, which are shuffled once whatever the
    number of draws: they are laid out by score in ranges, each range gives one row of vectors with a place for
    every draw, and the ranges of a group are added up. One row per group: days, rows, day_share (days on
    which the model's log loss is lower), the three figures and their ends. Rows without label or
    prediction don't count. A figure is null where it is undefined, as an AUC of one class.
    """
    on = [*groups, "_g"]
    if weight is None:
        rows, weight = collapsed(rows, [*groups, day, label, model, base]), "_c"
    c = F.col(weight)
    y, m, b = F.col(label).cast("double"), F.col(model).cast("double"), F.col(base).cast("double")
    rows = rows.where(y.isNotNull() & m.isNotNull() & b.isNotNull()).withColumn("_g", F.lit(1))
    sums = {"lm": log_loss(y, m), "lb": log_loss(y, b), "bm": (m - y) * (m - y), "bb": (b - y) * (b - y)}
    both = F.explode(F.array(F.struct(F.lit(1).alias("sign"), m.alias("p")), F.struct(F.lit(-1).alias("sign"), b.alias("p")))).alias("_x")
    daily = save(rows.groupBy(*on, day).agg(F.sum(c).alias("_n"), *[F.sum(x * c).alias(k) for k, x in sums.items()]))
    of = Window.partitionBy(*on)  # one row a day
    numbered = daily.select(*on, F.col(day).alias("_day"), (F.row_number().over(of.orderBy(day)) - 1).alias("day"), F.count("*").over(of).alias("days"))
    counts = rows.select(*on, F.col(day).alias("_day"), y.cast("int").alias("_y"), c.alias("_w"), both).groupBy(*on, "_day", "_x.sign", F.col("_x.p").alias("score")).agg(F.sum(F.col("_y") * F.col("_w")).cast("double").alias("pos"), F.sum((1 - F.col("_y")) * F.col("_w")).cast("double").alias("neg"))
    counts = _beside(counts, numbered, [*on, "_day"])
    keys = [*on, "sign"]
    laid = counts.select(*keys, "score", "day", "days", "pos", "neg").repartitionByRange(*keys, "score").sortWithinPartitions(*keys, "score")
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "low double", "pos array<double>", "neg array<double>", "wins array<double>"])
    pieces = laid.mapInArrow(lambda batches: bootstrap.rank_sums(batches, keys, auc_draws, seed), schema)
    losses_of, names = list(sums), ("log_loss_gain", "brier_gain", "auc_diff")
    out_columns = [*names, *[f"{c}_{e}" for c in names for e in ("low", "high")]]

    def figures(of_days: pa.Table, of_scores: pa.Table) -> pa.Table:
        days = of_days.sort_by(day)
        n = days.column("_n").to_numpy().astype(float)
        losses = {c: days.column(c).to_numpy() for c in losses_of}
        with np.errstate(divide="ignore", invalid="ignore"):
            total = bootstrap.draw_matrix(len(n), draws, seed) @ np.column_stack(list(losses.values()))
            drawn = [1 - np.where(total[:, k + 1] == 0, np.nan, total[:, k]) / total[:, k + 1] for k in (0, 2)]
        lead = 0.0
        for sign in (1, -1):
            mine = of_scores.filter(pc.equal(of_scores.column("sign"), sign))
            vector = lambda c, t=mine: np.array(t.column(c).to_pylist())
            lead = lead + sign * bootstrap.joined_sums(mine.column("low").to_numpy(), vector("pos"), vector("neg"), vector("wins"))
        found = [bootstrap.with_ends(x) for x in (*drawn, lead)]
        values = [len(n), int(n.sum()), float((losses["lm"] / n < losses["lb"] / n).mean()), *[x[0] for x in found], *[e for x in found for e in x[1:]]]
        types = [pa.int64(), pa.int64(), *[pa.float64()] * (len(out_columns) + 1)]
        return pa.Table.from_arrays([*[days.column(k).slice(0, 1) for k in on], *[pa.array([v], t) for v, t in zip(values, types, strict=True)]], [*on, "days", "rows", "day_share", *out_columns])

    result = ", ".join([*[f"`{k}` {kinds[k]}" for k in on], "days long", "rows long", "day_share double", *[f"{c} double" for c in out_columns]])
    return daily.groupBy(*on).cogroup(pieces.groupBy(*on)).applyInArrow(figures, result).drop("_g")


def gains_by(rows: DataFrame, groups: Sequence[str], label: str, model: str, base: str) -> DataFrame:
    """(groups, rows, gain): relative log-loss gain of a model over a base per group, such as a day or a slice value."""
    y, m, b = F.col(label).cast("double"), F.col(model), F.col(base)
    both = rows.where(y.isNotNull() & m.isNotNull() & b.isNotNull())
    return both.groupBy(*groups).agg(F.count("*").alias("rows"), (1 - F.avg(log_loss(y, m)) / F.avg(log_loss(y, b))).alias("gain"))
