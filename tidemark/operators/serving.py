"""Questions to the latest scores: which connections are at risk, and one connection by its two stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import local_iso, minutes
from ..functions.trains import display_name, nearest_cutoff


def latest_scores(scores: DataFrame, time: str = "scored_at") -> DataFrame:
    """The rows of the last run; a run's time is the same in all its rows, so one maximum finds it."""
    last = scores.agg(F.max(time).alias("_last"))
    return scores.join(F.broadcast(last), F.col(time) == F.col("_last")).drop("_last")


def _shown(rows: DataFrame, now: Column, cutoffs: tuple[int, ...]) -> DataFrame:
    left = minutes(F.col("pt_a"), now)
    return rows.select(
        "hub", "stop_id_a", "stop_id_b", "status", F.col("p_model").alias("risk"), left.alias("minutes_to_arrival"), nearest_cutoff(left, cutoffs).alias("cutoff_min"),
        display_name(F.col("cat_a"), F.col("line_a"), F.col("num_a")).alias("train_a"), display_name(F.col("cat_b"), F.col("line_b"), F.col("num_b")).alias("train_b"), local_iso(F.col("pt_a")).alias("arrives"), local_iso(F.col("pt_b")).alias("departs"),
    )


def connections(scores: DataFrame, now: Column, hub: str | None = None, within_min: float | None = None, min_risk: float | None = None, include_unscored: bool = False, cutoffs: tuple[int, ...] = (60, 30, 10)) -> DataFrame:
    """Connections of the last run, those without a score only if asked for; min_risk never hides the unscored ones asked for."""
    rows = latest_scores(scores)
    if hub is not None:
        rows = rows.where(F.col("hub") == hub)
    if within_min is not None:
        rows = rows.where((minutes(F.col("pt_a"), now) >= 0) & (minutes(F.col("pt_a"), now) <= within_min))
    scored = F.col("p_model").isNotNull()
    if not include_unscored:
        rows = rows.where(scored)
    if min_risk is not None:
        rows = rows.where(~scored | (F.col("p_model") >= min_risk))
    return _shown(rows, now, cutoffs)


def connection(scores: DataFrame, now: Column, stop_a: str, stop_b: str, cutoffs: tuple[int, ...] = (60, 30, 10)) -> DataFrame:
    """The one connection between two stops in the last run; no row if it has none."""
    return _shown(latest_scores(scores).where((F.col("stop_id_a") == stop_a) & (F.col("stop_id_b") == stop_b)), now, cutoffs)
