"""Calendars and folds as tables: what each day is for, and which days each model may see."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType


class LockedDays(RuntimeError):
    """Rows of days that are set aside were asked for."""


@dataclass(frozen=True)
class Period:
    """A named stretch of days, both ends included; without a last day it has no end."""

    name: str
    first: str
    last: str | None = None


def period(day: Column, periods: Sequence[Period]) -> Column:
    """The name of the first period that holds the day, else `outside`."""
    out = F.lit("outside")
    for p in reversed(periods):
        inside = day >= F.lit(p.first).cast("date")
        if p.last is not None:
            inside = inside & (day <= F.lit(p.last).cast("date"))
        out = F.when(inside, p.name).otherwise(out)
    return out


def calendar(rows: DataFrame, day: str, periods: Sequence[Period]) -> DataFrame:
    """(day, period, rows) of the days that have rows: of a table partitioned by day, a partition listing."""
    return rows.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("rows")).select("day", period(F.col("day"), periods).alias("period"), "rows")


def days_of(rows: DataFrame, day: str, periods: Sequence[Period], name: str, locked: Collection[str] = (), allow: Collection[str] = ()) -> DataFrame:
    """The rows of one period, unless it is locked and not allowed: that is an error before any row is read."""
    if name not in {p.name for p in periods}:
        raise ValueError(f"unknown period {name!r}")
    if name in locked and name not in allow:
        raise LockedDays(f"period {name!r} is set aside")
    return rows.where(period(F.col(day), periods) == name)


def checked(rows: DataFrame, day: str, periods: Sequence[Period], locked: Collection[str], allow: Collection[str] = ()) -> DataFrame:
    """The rows, once no day of them lies in a locked period; only the day column is read for that."""
    closed = [n for n in locked if n not in allow]
    hit = calendar(rows, day, periods).where(F.col("period").isin(*closed)).orderBy("day").limit(3).collect() if closed else []
    if hit:
        raise LockedDays("days set aside: " + ", ".join(f"{r['day']} ({r['period']})" for r in hit))
    return rows


def numbered(rows: DataFrame, day: str) -> DataFrame:
    """(day, n) of the distinct days in order, from 1: a calendar's worth of rows."""
    return rows.select(F.col(day).alias("day")).where(F.col(day).isNotNull()).distinct().withColumn("n", F.row_number().over(Window.orderBy("day")))


def _days_between(days: DataFrame, later: str, earlier: str) -> Column:
    return F.datediff(later, earlier) if isinstance(days.schema["day"].dataType, DateType) else F.col(later) - F.col(earlier)


def fold_table(rows: DataFrame, day: str, min_fit: int, block: int = 1, window: int = 0) -> DataFrame:
    """(fold, day, role): folds that fit on the past and evaluate on the next `block` days.

    The first fold fits on `min_fit` days. Later ones see all days before theirs, or with `window` only
    those less than so many calendar days older than the newest of them. Days before the first
    evaluated one have the role `fit` only.
    """
    days = numbered(rows, day)
    last = days.agg(F.max("n").alias("last"))
    of = F.floor((F.col("n") - 1 - min_fit) / block).cast("int")
    evaluate = days.where(F.col("n") > min_fit).select(of.alias("fold"), "day", F.lit("evaluate").alias("role"))
    first_fold = F.greatest(F.lit(0), F.ceil((F.col("n") - min_fit) / block)).cast("int")
    last_fold = F.floor((F.col("last") - 1 - min_fit) / block).cast("int")
    fit = days.crossJoin(F.broadcast(last)).where((F.col("last") > min_fit) & (first_fold <= last_fold)).withColumn("fold", F.explode(F.sequence(first_fold, last_fold)))
    newest = days.select(F.col("day").alias("newest"), F.col("n").alias("_n"))
    fit = fit.join(newest, F.col("_n") == min_fit + F.col("fold") * block)
    if window:
        fit = fit.where(_days_between(days, "newest", "day") < window)
    return evaluate.unionByName(fit.select("fold", "day", F.lit("fit").alias("role")))


def leave_one_out(rows: DataFrame, day: str) -> DataFrame:
    """(fold, day, role): each day is evaluated once, by a fit on all others."""
    days = numbered(rows, day)
    others = days.select(F.col("n").alias("_n"))
    both = days.join(F.broadcast(others))
    return both.select((F.col("_n") - 1).alias("fold"), "day", F.when(F.col("n") == F.col("_n"), "evaluate").otherwise("fit").alias("role"))


def day_blocks(rows: DataFrame, day: str, blocks: int) -> DataFrame:
    """(fold, day, role): as many blocks of consecutive days (or one a day), each evaluated by a fit on the others."""
    days = numbered(rows, day)
    n = days.count()
    blocks = min(blocks, n)
    if blocks < 2:
        return days.select(F.lit(0).alias("fold"), "day", F.lit("fit").alias("role")).limit(0)
    own = F.floor((F.col("n") - 1) * blocks / n).cast("int")
    return days.select("day", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("fold")).select("fold", "day", F.when(F.col("fold") == F.col("_own"), "evaluate").otherwise("fit").alias("role"))
