"""State of a hub on a time grid, each value as it could be known then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import ceil_to, floor_to, minutes, shifted
from ..functions.trains import path
from .asof import asof_join


def events_on_grid(plan: DataFrame, obs: DataFrame, g_from: Column | None = None, g_to: Column | None = None, step: int = 5, back: int = 60, around: int = 30, late: float = 5.0) -> DataFrame:
    """Each planned event at each grid time that can see it, with its state then.

    An event is seen from `around` minutes before to max(back, around) minutes after its time, once its
    plan is known; that is a bounded number of grid points, fewer with the bounds g_from and g_to. One as-of join gives all states.
    plan: eva, key, event, pt, line, first_seen. obs: key, obs, ct, cs.
    """
    low = shifted(F.col("pt"), -around)
    first, last = ceil_to(low, step), floor_to(shifted(F.col("pt"), max(back, around)), step)
    first = first if g_from is None else F.greatest(first, floor_to(g_from, step))
    last = last if g_to is None else F.least(last, floor_to(g_to, step))
    span = F.sequence(F.unix_micros(first), F.unix_micros(last), F.lit(step * 60_000_000).cast("long"))
    seen = plan.where(first <= last).withColumn("_g", F.explode(span)).withColumn("g", F.timestamp_micros("_g")).drop("_g").where("first_seen <= g")
    state = asof_join(seen, obs.select("key", "obs", "ct", "cs"), ["key"], "g", "obs", ["ct", "cs"], tie=["ct", "cs"])
    cancel = F.coalesce(F.col("cs") == "c", F.lit(False))
    delay = minutes(F.coalesce("ct", "pt"), F.col("pt"))
    return state.select("eva", "g", "event", "pt", "line", cancel.alias("cancel"), F.when(~cancel, delay).alias("delay"), F.when(~cancel, (delay >= late).cast("double")).alias("late"))


def hub_state(on_grid: DataFrame, around: int = 30) -> DataFrame:
    """Per hub and grid time: share cancelled, mean delay and share late of the events at most `around` minutes off."""
    near = on_grid.where(F.abs(minutes(F.col("pt"), F.col("g"))) <= around)
    return near.groupBy("eva", "g").agg(F.avg(F.col("cancel").cast("double")).alias("hub_share_cancel"), F.avg("delay").alias("hub_mean_delay"), F.avg("late").alias("hub_share_late5"))


def line_state(on_grid: DataFrame, back: int = 60) -> DataFrame:
    """Per hub, grid time and line: mean delay of the running arrivals of the last `back` minutes, (g - back, g]."""
    age = minutes(F.col("g"), F.col("pt"))
    recent = on_grid.where((F.col("event") == "ar") & (age >= 0) & (age < back) & ~F.col("cancel") & F.col("line").isNotNull())
    return recent.groupBy("eva", "g", "line").agg(F.avg("delay").alias("line_recent_delay_a"))


def with_hub_state(rows: DataFrame, hubs: DataFrame, lines: DataFrame, step: int = 5) -> DataFrame:
    """Adds to rows (eva, t_cut, line_a) the states of the last grid time at or before the cutoff."""
    asked = rows.withColumn("_g", floor_to(F.col("t_cut"), step))
    h = hubs.select(F.col("eva").alias("_e"), F.col("g").alias("_hg"), "hub_share_cancel", "hub_mean_delay", "hub_share_late5")
    n = lines.select(F.col("eva").alias("_le"), F.col("g").alias("_lg"), F.col("line").alias("_ll"), "line_recent_delay_a")
    out = asked.join(h, (F.col("eva") == F.col("_e")) & (F.col("_g") == F.col("_hg")), "left").join(n, (F.col("eva") == F.col("_le")) & (F.col("_g") == F.col("_lg")) & (F.col("line_a") == F.col("_ll")), "left")
    return out.drop("_g", "_e", "_hg", "_le", "_lg", "_ll")


def with_corridor(rows: DataFrame, feeders: DataFrame, hubs: DataFrame, lines: DataFrame, row: str, path_col: str, known: Column, step: int = 5, suffix: str = "a") -> DataFrame:
    """Adds the states at the feeder stations on a row's path, averaged, if its plan was known.

    feeders: name, eva (a small dimension). Rows without a feeder on the path have nulls.
    """
    on = rows.where(known).select(F.col(row).alias("_row"), floor_to(F.col("t_cut"), step).alias("_g"), F.col("line_a").alias("_line"), F.explode(path(F.col(path_col))).alias("name"))
    at = on.join(feeders.select("name", F.col("eva").alias("_e")), "name")
    h = hubs.select(F.col("eva").alias("_he"), F.col("g").alias("_hg"), "hub_mean_delay")
    n = lines.select(F.col("eva").alias("_le"), F.col("g").alias("_lg"), F.col("line").alias("_ll"), "line_recent_delay_a")
    at = at.join(h, (F.col("_e") == F.col("_he")) & (F.col("_g") == F.col("_hg")), "left").join(n, (F.col("_e") == F.col("_le")) & (F.col("_g") == F.col("_lg")) & (F.col("_line") == F.col("_ll")), "left")
    means = at.groupBy("_row").agg(F.avg("hub_mean_delay").alias(f"corridor_delay_{suffix}"), F.avg("line_recent_delay_a").alias(f"corridor_line_delay_{suffix}"))
    return rows.join(means, F.col(row) == F.col("_row"), "left").drop("_row")
