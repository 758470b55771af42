"""What was known at a time: as-of joins, latest versions, last states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(queries: DataFrame, facts: DataFrame, key: Sequence[str], query_time: str, fact_time: str, values: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Adds to each query the last fact of its key at or before its time, as one row: a newer fact hides all of an older one.

    Facts of one time are ordered by `tie` (nulls first), so the result is defined. Queries and facts go
    through one shuffle by key and one running window; queries without a fact, or with a null key or
    time, stay, with nulls. The fact's time comes along under its own name.
    """
    state = F.struct(F.col(fact_time), *[F.col(v) for v in values])
    names = [f"_q{i}" for i in range(len(queries.columns))]
    left = queries.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(query_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c).alias(n) for c, n in zip(queries.columns, names, strict=True)]).alias("_q")
    )
    right = facts.where(F.col(fact_time).isNotNull()).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(fact_time).alias("_t"), F.lit(0).alias("_side"), state.alias("_f"), *[F.col(t).alias(f"_o{i}") for i, t in enumerate(tie)]
    )
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy("_t", "_side", *[f"_o{i}" for i in range(len(tie))]).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last("_f", ignorenulls=True).over(w)
    known = F.col("_t").isNotNull()
    for i in range(len(key)):
        known = known & F.col(f"_k{i}").isNotNull()
    out = both.withColumn("_s", F.when(known, seen)).where("_side = 1")
    return out.select(*[F.col(f"_q.{n}").alias(c) for c, n in zip(queries.columns, names, strict=True)], *[F.col(f"_s.{v}").alias(v) for v in (fact_time, *values)])


def asof_join_in_parts(queries: DataFrame, facts: DataFrame, key: Sequence[str], query_time: str, fact_time: str, values: Sequence[str], tie: Sequence[str] = (), part: str = "hour") -> DataFrame:
    """asof_join() for keys of any size: the unit of work is a key's hour (or other `part` of date_trunc), not the key.

    The last fact of each hour, and of all hours before it by a running pick over a key's hours (one row an hour),
    is handed to the hours that are asked for as one more fact, under its own time. One as-of pass inside
    (key, hour) then answers everything, so a key with half of all rows spreads over its hours. A part should hold
    no more rows of a key than a task can sort.
    """
    cut = lambda c: F.date_trunc(part, F.col(c))
    state = F.struct(F.col(fact_time).alias("_t"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(tie)], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    order = F.struct(F.col(fact_time), *[F.col(c) for c in tie])
    known = facts.where(F.col(fact_time).isNotNull())
    hourly = known.groupBy(*key, cut(fact_time).alias("_part")).agg(F.max_by(state, order).alias("_s"))
    asked = queries.select(*key, cut(query_time).alias("_part")).where(F.col("_part").isNotNull()).distinct()
    both = hourly.unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True).groupBy(*key, "_part").agg(F.max_by("_s", F.col("_s").isNotNull()).alias("_s"), F.max("_asked").alias("_asked"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("_c", F.last("_s", ignorenulls=True).over(before)).where("_asked AND _c IS NOT NULL")
    named = {fact_time: "_c._t"} | {v: f"_c._v{i}" for i, v in enumerate(values)} | {c: f"_c._o{i}" for i, c in enumerate(tie)}
    carried = carried.select(*key, "_part", *[F.col(x).alias(c) for c, x in named.items()])
    own = known.select(*key, cut(fact_time).alias("_part"), *named)
    return asof_join(queries.withColumn("_part", cut(query_time)), own.unionByName(carried), [*key, "_part"], query_time, fact_time, values, tie).drop("_part")


def last_time(queries: DataFrame, times: DataFrame, key: str, query_time: str, fact_time: str, out: str) -> DataFrame:
    """The last time of a key at or before each query's: for few keys with very many times.

    Keys are divided by the hour. The last time of each hour and a running maximum over hours (a
    small table) answer for the hours before, an as-of join inside (key, hour) for the query's own.
    """
    hour = lambda c: F.date_trunc("hour", c)
    hourly = times.groupBy(F.col(key).alias("_k"), hour(F.col(fact_time)).alias("_h")).agg(F.max(fact_time).alias("_last"))
    asked = queries.select(F.col(key).alias("_k"), hour(F.col(query_time)).alias("_h")).distinct()
    grid = hourly.unionByName(asked, allowMissingColumns=True).groupBy("_k", "_h").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("_k").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_earlier", F.max("_last").over(before)).select("_k", "_h", "_earlier")
    named = queries.withColumn("_h", hour(F.col(query_time)))
    facts = times.select(F.col(key), hour(F.col(fact_time)).alias("_h"), F.col(fact_time).alias("_own")).distinct()
    inside = asof_join(named, facts, [key, "_h"], query_time, "_own", [])
    joined = inside.join(grid.withColumnRenamed("_h", "_g"), (F.col(key) == F.col("_k")) & (F.col("_h") == F.col("_g")), "left")
    return joined.select(*queries.columns, F.coalesce("_own", "_earlier").alias(out))


def latest_version(rows: DataFrame, key: Sequence[str], time: str, columns: Sequence[str], tie: Sequence[str] = (), first_seen: str = "first_seen") -> DataFrame:
    """The latest known value of each column by itself, nulls skipped, and when the key was first seen."""
    order = F.struct(time, *tie) if tie else F.col(time)
    picked = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    return rows.groupBy(*key).agg(*picked, F.min(time).alias(first_seen))


def last_state(rows: DataFrame, key: Sequence[str], time: str, values: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The last row of each key, whole."""
    order = F.struct(time, *(tie or values))
    return rows.groupBy(*key).agg(F.max_by(F.struct(F.col(time), *values), order).alias("_m")).select(*key, "_m.*")


def first_seen(rows: DataFrame, key: Sequence[str], time: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.min(time).alias(time))


def count_seen(queries: DataFrame, firsts: DataFrame, row: str, key: str, query_time: str, fact_time: str, counts: dict[str, Column]) -> DataFrame:
    """How many first sightings of its key each query could know, for several conditions in one pass.

    counts: name -> condition on the sightings. Queries without any have zeros.
    """
    facts = firsts.select(F.col(key).alias("_k"), F.col(fact_time).alias("_seen"), *[c.alias(f"_c{i}") for i, c in enumerate(counts.values())])
    joined = queries.select(F.col(row).alias("_row"), F.col(key).alias("_qk"), F.col(query_time).alias("_qt")).join(facts, (F.col("_qk") == F.col("_k")) & (F.col("_seen") <= F.col("_qt")))
    found = joined.groupBy("_row").agg(*[F.count_if(F.col(f"_c{i}")).alias(f"_n{i}") for i in range(len(counts))])
    out = queries.join(found, F.col(row) == F.col("_row"), "left")
    return out.select(*queries.columns, *[F.coalesce(f"_n{i}", F.lit(0)).alias(n) for i, n in enumerate(counts)])


def poll_gap(rows: DataFrame, key: Sequence[str], time: str, out: str = "gap_s") -> DataFrame:
    """Seconds since the row before of the same key; null for the first.

    For few keys with very many rows: windows run inside (key, hour), and the last time of the hours before, a
    small table, answers for the first row of an hour.
    """
    hour = F.date_trunc("hour", F.col(time))
    inside = Window.partitionBy(*key, "_h").orderBy(time)
    before = Window.partitionBy(*key).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hourly = rows.groupBy(*key, hour.alias("_h")).agg(F.max(time).alias("_last")).withColumn("_earlier", F.max("_last").over(before)).drop("_last")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)] + [F.col("_h").eqNullSafe(F.col("_g"))]
    hourly = hourly.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_h").alias("_g"), "_earlier")
    lagged = rows.withColumn("_h", hour).withColumn("_lag", F.lag(time).over(inside))
    gap = (F.unix_micros(time) - F.unix_micros(F.coalesce("_lag", "_earlier"))) / F.lit(1e6)
    return lagged.join(hourly, on, "left").select(*rows.columns, gap.alias(out))


def trailing_count(rows: DataFrame, key: Sequence[str], time: str, seconds: int, out: str) -> DataFrame:
    """Rows of the same key in the last `seconds` up to and including each row's time.

    Rows are listed under their own hour and under the next ones that their time reaches into, so a key's window
    runs inside an hour. A null time counts no row.
    """
    at = F.col(time)
    mark = lambda x: F.floor(F.unix_micros(x) / F.lit(3_600_000_000).cast("decimal(20,0)")).cast("long")
    until = F.floor((F.unix_micros(at) + seconds * 1_000_000) / F.lit(3_600_000_000).cast("decimal(20,0)")).cast("long")
    listed = rows.withColumn("_own", mark(at)).withColumn("_h", F.explode_outer(F.sequence(F.col("_own"), until)))
    w = Window.partitionBy(*key, "_h").orderBy(F.unix_micros(time)).rangeBetween(-seconds * 1_000_000, 0)
    counted = listed.withColumn(out, F.count(time).over(w)).where(F.col("_own").eqNullSafe(F.col("_h")))
    return counted.select(*rows.columns, out)
