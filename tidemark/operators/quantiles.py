"""Exact quantiles by distributed selection: no task holds a column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import save

#: Rank error of the approximate cut points, one in so many; groups up to 40 times as large are searched whole.
ACCURACY = 10_000
#: So many groups are broadcast with their cut points; of more, those above a thousandth of all rows.
FEW = 1_000


def _with_bounds(rows: DataFrame, bounds: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows beside their group's bounds; a group that holds many rows is never shuffled to one task."""
    named = bounds.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], "_lo", "_hi", "_rows")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(groups)], F.lit(True))
    drop = [f"_g{i}" for i in range(len(groups))]
    size = bounds.agg(F.count("*"), F.sum("_rows")).first()
    if size[0] <= FEW:
        return rows.join(F.broadcast(named), same).drop(*drop)
    hot = F.col("_rows") > (size[1] or 0) / FEW
    large = F.broadcast(named.where(hot))
    return rows.join(large, same).unionByName(rows.join(large, same, "left_anti").join(named.where(~hot), same)).drop(*drop)


def exact_quantiles(rows: DataFrame, groups: Sequence[str], x: str | Column, at: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(groups, n, quantiles): the interpolated quantiles of each group, as percentile() gives them, in the order of `at`.

    Nulls and NaN don't count; a group without a number has n 0 and null quantiles. Null is a group of its own.

    A first pass makes approximate cut points a little below and above each quantile (a sketch a group, combined before the
    shuffle). A second counts the rows below the cut points and the rows of each value between them, which are a few
    in 10,000 of a large group. Running sums over these values then reach the exact ranks. Small groups lie between their cut
    points whole. A value that fills more than its share is one row, whatever its count. Rows are written once.
    """
    if not at:
        raise ValueError("no quantile is asked for")
    number = F.col(x) if isinstance(x, str) else x
    keys = [f"_k{i}" for i in range(len(groups))]
    rows = save(rows.select(*[F.col(c).alias(k) for c, k in zip(groups, keys, strict=True)], F.nanvl(number.cast("double"), F.lit(None).cast("double")).alias("_x")))
    margin = 3 / accuracy
    cuts = F.percentile_approx("_x", [min(1.0, max(0.0, q + d)) for d in (-margin, margin) for q in at], accuracy)
    ends = rows.groupBy(*keys).agg(cuts.alias("_cuts"), F.count("_x").alias("_rows"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    whole = F.col("_rows") < 40 * accuracy
    k = len(at)
    low = F.when(whole, F.array_repeat("_min", k)).otherwise(F.slice("_cuts", 1, k))
    high = F.when(whole, F.array_repeat("_max", k)).otherwise(F.slice("_cuts", k + 1, k))
    bounds = save(ends.select(*keys, "_rows", low.alias("_lo"), high.alias("_hi")))

    beside = _with_bounds(rows.where("_x IS NOT NULL"), bounds, keys)
    below = beside.groupBy(*keys).agg(F.array(*[F.count_if(F.col("_x") < F.col("_lo")[i]) for i in range(k)]).alias("_below"))
    # quantiles of equal cut points, as all of a small group, share their values
    first = lambda i: F.least(*[F.when((F.col("_lo")[j] == F.col("_lo")[i]) & (F.col("_hi")[j] == F.col("_hi")[i]), j).otherwise(i) for j in range(i)], F.lit(i)) if i else F.lit(0)
    inside = [F.when((first(i) == i) & F.col("_x").between(F.col("_lo")[i], F.col("_hi")[i]), F.lit(i)) for i in range(k)]
    between = beside.select(*keys, "_x", F.explode(F.array_compact(F.array(*inside))).alias("_i"))
    counts = between.groupBy(*keys, "_i", "_x").agg(F.count("*").alias("_c"))

    same = lambda a, b: reduce(lambda p, q: p & q, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys], F.lit(True))
    totals = bounds.alias("b").join(below.alias("l"), same("b", "l"), "left").select(*[F.col(f"b.{c}") for c in keys], "_rows", "_below", F.array(*[first(i) for i in range(k)]).alias("_first"))
    # one row a group: (quantile, its interval, the two ranks around it, weight of the upper one)
    asked = []
    for i, q in enumerate(at):
        place = F.lit(float(q)) * (F.col("_rows") - 1)
        asked.append(F.struct(F.lit(i).alias("at"), F.col("_first")[i].alias("_i"), F.floor(place).alias("r0"), F.ceil(place).alias("r1"), (place - F.floor(place)).alias("w"), F.col("_below")[i].alias("under")))
    targets = totals.where("_rows > 0").select(*keys, F.explode(F.array(*asked)).alias("_a")).select(*keys, "_a.*")
    wanted = targets.groupBy(*keys, "_i").agg(F.collect_list(F.struct("at", "r0", "r1", "w", "under")).alias("_t"))  # at most one for each quantile asked for
    # the asked ranks are the first row of their interval's window, so no value is joined; _upto counts inside the interval
    upto = Window.partitionBy(*keys, "_i").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.unionByName(wanted, allowMissingColumns=True).select(*keys, "_x", "_c", F.sum("_c").over(upto).alias("_upto"), F.first("_t", ignorenulls=True).over(upto).alias("_t")).where("_x IS NOT NULL")
    held = lambda t, r: (t["under"] + F.col("_upto") - F.col("_c") <= t[r]) & (t[r] < t["under"] + F.col("_upto"))
    near = summed.select("*", F.explode(F.filter("_t", lambda t: held(t, "r0") | held(t, "r1"))).alias("_a"))
    hits = near.select(*keys, "_x", "_a.at", "_a.w", held(F.col("_a"), "r0").alias("low"), held(F.col("_a"), "r1").alias("high"))
    values = hits.groupBy(*keys, "at").agg(F.max(F.when(F.col("low"), F.col("_x"))).alias("v0"), F.max(F.when(F.col("high"), F.col("_x"))).alias("v1"), F.max("w").alias("w"))
    told = values.withColumn("_q", F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise((1 - F.col("w")) * F.col("v0") + F.col("w") * F.col("v1")))
    lists = told.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "_q"))).alias("_qs"))
    out = bounds.alias("b").join(lists.alias("v"), same("b", "v"), "left")
    value = lambda i: F.when((F.col("_rows") > 0) & F.col("_qs")[i].isNull(), F.raise_error(F.lit("a rank lies outside its cut points")).cast("double")).otherwise(F.col("_qs")[i])
    return out.select(*[F.col(f"b.{a}").alias(c) for a, c in zip(keys, groups, strict=True)], F.col("_rows").alias("n"), F.array(*[value(i) for i in range(k)]).alias("quantiles"))


def beside(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """left with the columns of right, of which each has one row a group; nulls equal nulls."""
    if not groups:
        return left.crossJoin(F.broadcast(right))  # one row each
    named = right.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(groups)], *[c for c in right.columns if c not in groups])
    return left.join(named, [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(groups)], "left").drop(*[f"_r{i}" for i in range(len(groups))])


def quantile_columns(rows: DataFrame, groups: Sequence[str], columns: dict[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """The groups with a column for each quantile: {"lag": ("lag_s", (0.5, 0.95))} gives lag_p50 and lag_p95."""
    at = sorted({q for _, asked in columns.values() for q in asked})
    items = [F.struct(F.lit(name).alias("_name"), F.col(x).cast("double").alias("_number")) for name, (x, _) in columns.items()]
    long = rows.select(*groups, F.explode(F.array(*items)).alias("_n")).select(*groups, "_n.*")
    found = exact_quantiles(long, [*groups, "_name"], "_number", at)
    named = [F.max(F.when(F.col("_name") == name, F.col("quantiles")[at.index(q)])).alias(f"{name}_p{round(q * 100):02d}") for name, (_, asked) in columns.items() for q in asked]
    return found.groupBy(*groups).agg(*named)
