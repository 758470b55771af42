"""Column functions on stops, paths and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories of long-distance trains.
LONG_DISTANCE = ("ICE", "IC", "EC", "ECE", "EUR", "FLX", "NJ", "TGV", "RJ", "RJX", "EN", "ES", "WB", "TRI")


def trip_key(stop_id: Column) -> Column:
    """A stop id without its last -number; the id may itself begin with a minus."""
    return F.when(stop_id != "", F.regexp_replace(stop_id, "-[0-9]+$", ""))


def path(text: Column) -> Column:
    """'A|B' -> ['A', 'B']; null and empty parts vanish."""
    # a plain separator and no lambda: both stay in generated code and no pattern is compiled a row
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "\\|"), "")


def first(stations: Column) -> Column:
    return F.try_element_at(stations, F.lit(1))


def last(stations: Column) -> Column:
    return F.try_element_at(stations, F.lit(-1))


def segment(category: Column) -> Column:
    return F.when(category.isNull(), "unknown").when(category == "S", "S-Bahn").when(category.isin(*LONG_DISTANCE), "long-distance").otherwise("regional")


def display_name(category: Column, line: Column, number: Column) -> Column:
    """The line, led by its category unless it already begins with it; without a line, category and number."""
    named = F.when(F.startswith(line, category), line).otherwise(F.concat(category, line))
    return F.when(line.isNotNull() & (line != ""), F.coalesce(named, line)).otherwise(F.concat_ws(" ", category, number))


def bucket(x: Column, edges: Sequence[float]) -> Column:
    """Number of the half-open bin [edge, next edge) that holds x; -1 outside and for null."""
    out = F.lit(-1)
    for i in range(len(edges) - 1):
        out = F.when((x >= edges[i]) & (x < edges[i + 1]), i).otherwise(out)
    return out.cast("int")


def clean_eva(eva: Column) -> Column:
    """A station number without leading zeros."""
    return F.regexp_replace(eva.cast("string"), "^0+", "")


def nearest_cutoff(x: Column, cutoffs: Sequence[int]) -> Column:
    """The trained cutoff next to x; of two as near, the smaller."""
    best = F.array_min(F.array(*[F.struct(F.abs(x - c).alias("d"), F.lit(c).alias("c")) for c in cutoffs]))
    return F.when(x.isNotNull(), best["c"])
