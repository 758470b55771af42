"""Feature groups of training and live rows; none uses anything collected after a row's cutoff."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import minute_mark, minutes, shifted
from .asof import asof_join, count_seen, first_seen

GROUPS = {
    "db": ("db_slack_min", "db_delay_a_min", "db_delay_b_min", "b_cancel_known"),
    "hub": ("hub_mean_delay", "hub_share_late5", "hub_share_cancel", "line_recent_delay_a"),
    "freshness": ("age_a_min", "age_b_min"),
    "context": ("planned_slack_min", "hour_sin", "hour_cos", "day_type", "n_stations_before_a", "same_platform", "segment_a", "segment_b", "hub"),
    "trend": ("trend_a_15", "trend_a_30", "trend_b_15"),
    "messages": ("n_delay_codes_a", "n_quality_a", "n_delay_codes_b", "h_notice_a", "h_notice_b", "c_notice_a"),
    "feeder": ("corridor_delay_a", "corridor_line_delay_a", "corridor_delay_b"),
}


def feature_columns(groups: Sequence[str]) -> list[str]:
    """Columns of the groups in order, each once; an unknown group is an error."""
    unknown = [g for g in groups if g not in GROUPS]
    if unknown:
        raise ValueError(f"no such feature group: {unknown}")
    return list(dict.fromkeys(c for g in groups for c in GROUPS[g]))


def message_sightings(rows: DataFrame, key: str, text: str, time: str) -> DataFrame:
    """(key, type, code, time) of each message first seen; messages are 'type:code' joined by |."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), "[|]"), lambda x: x != "")
    parts = rows.select(key, time, F.explode(F.transform(tokens, lambda x: F.split(x, ":", 2))).alias("_m")).select(key, time, F.element_at("_m", 1).alias("type"), F.coalesce(F.try_element_at("_m", F.lit(2)), F.lit("")).alias("code"))
    return first_seen(parts, [key, "type", "code"], time)


def plan_changes(rows: DataFrame, key: Sequence[str], planned: str) -> DataFrame:
    """Keys that were planned for more than one time."""
    return rows.groupBy(*key).agg(F.count_distinct(planned).alias("planned_times")).where("planned_times > 1")


def messages(rows: DataFrame, sightings: DataFrame, row: str, key: str, types: dict[str, str], time: str = "obs") -> DataFrame:
    """Adds how many messages of each type were first seen by the cutoff: name -> type."""
    return count_seen(rows, sightings, row, key, "t_cut", time, {name: F.col("type") == t for name, t in types.items()})


def trend(rows: DataFrame, obs: DataFrame, row: str, key: str, planned: str, back: Sequence[int] = (15, 30), prefix: str = "trend_a") -> DataFrame:
    """Adds the change of the predicted delay over the last minutes: all look-backs in one as-of pass."""
    asked = rows.select(F.col(row).alias("_row"), F.col(key).alias("key"), F.col(planned).alias("_pt"), "t_cut", F.explode(F.array(*[F.lit(b) for b in (0, *back)])).alias("_back")).withColumn("_at", shifted(F.col("t_cut"), -F.col("_back")))
    state = asof_join(asked, obs.select("key", "obs", "ct", "cs"), ["key"], "_at", "obs", ["ct"], tie=["ct", "cs"])
    delay = minutes(F.coalesce("ct", "_pt"), F.col("_pt"))
    at = lambda b: F.max(F.when(F.col("_back") == b, delay))
    wide = state.groupBy("_row").agg(*[(at(0) - at(b)).alias(f"{prefix}_{b}") for b in back])
    return rows.join(wide, F.col(row) == F.col("_row"), "left").drop("_row")


def freshness(rows: DataFrame, obs: DataFrame, key: str, out: str) -> DataFrame:
    """Adds the minute marks since the last observation by the cutoff's minute mark; null if there is none."""
    asked = rows.withColumn("_mark", minute_mark(F.col("t_cut")))
    facts = obs.select(F.col("key").alias(key), F.col("obs").alias("_seen"))
    state = asof_join(asked, facts, [key], "_mark", "_seen", [])
    return state.withColumn(out, minutes(F.col("_mark"), minute_mark(F.col("_seen")))).drop("_mark", "_seen")


def context(rows: DataFrame, holidays: Sequence[str] = (), zone: str = "Europe/Berlin") -> DataFrame:
    """Adds the local hour on the circle, the type of day, and whether both trains use one platform."""
    local = F.from_utc_timestamp("pt_a", zone)
    angle = (F.hour(local) + F.minute(local) / 60) * (2 * math.pi / 24)
    holiday = F.to_date(local).cast("string").isin(*holidays) if holidays else F.lit(False)
    kind = F.when(holiday | (F.dayofweek(local) == 1), "sunday_holiday").when(F.dayofweek(local) == 7, "saturday").otherwise("weekday")
    same = F.coalesce(F.col("pp_a") == F.col("pp_b"), F.lit(False)).cast("int")
    return rows.select("*", F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"), kind.alias("day_type"), same.alias("same_platform"))
