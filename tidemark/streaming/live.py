"""Structured Streaming forms of the live pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.asof import last_state, last_time
from ..sources.raw import parse_responses


def run_to(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Starts a stream into Parquet files; without `every` it works off what is there and ends."""
    writer = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def parse_stream(raw: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Raw responses into the parsed table, partitioned by source and date, as they arrive."""
    rows = parse_responses(raw.where("_bad IS NULL")).withColumn("date", F.to_date("collected_at"))
    writer = rows.writeStream.format("parquet").partitionBy("source", "date").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def carried_state(carried: DataFrame, batch: DataFrame, key: Sequence[str], time: str, values: Sequence[str], keep_from: Column | None = None) -> DataFrame:
    """The last state of each key after a batch. A carried row stands in for all older ones and never hides a later one;
    keys last seen before `keep_from` are forgotten."""
    both = carried.select(*key, time, *values).unionByName(batch.select(*key, time, *values))
    out = last_state(both, key, time, values)
    return out if keep_from is None else out.where(F.col(time) >= keep_from)


def drop_old_snapshots(spark: SparkSession, path: str, n: int) -> None:
    """Removes the snapshot n of a stream's table, through Spark's file system, so that only the last ones stay."""
    if n >= 0:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/n={n}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def state_stream(rows: DataFrame, path: str, checkpoint: str, key: Sequence[str], time: str, values: Sequence[str], every: str | None = None, keep: str | None = None) -> StreamingQuery:
    """Keeps the last state of each key in numbered snapshots under `path`, of which the last two stay.

    A batch that runs again after a failure writes the same snapshot from the same one before it. With `keep`
    (an interval such as '48 hours') keys whose last row is older than the newest one by more are
    forgotten, which bounds the snapshot by the keys of that stretch.
    """

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = batch.select(*key, time, *values).limit(0)
        if number > 0:
            before = spark.read.parquet(f"{path}/n={number - 1}")
        since = None
        if keep is not None:
            newest = before.select(time).unionByName(batch.select(time)).agg(F.max(time)).first()[0]
            since = None if newest is None else F.lit(newest) - F.expr(f"INTERVAL {keep}")
        carried_state(before, batch, key, time, values, since).write.mode("overwrite").parquet(f"{path}/n={number}")
        drop_old_snapshots(spark, path, number - 2)

    writer = rows.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def log_once(scored: DataFrame, key: Sequence[str], time: str, mark: str, max_late_min: int = 5, forget: str = "2 hours") -> DataFrame:
    """Each key once, at the first run at or after its mark and at most `max_late_min` after it.

    Keys are forgotten `forget` after the latest time seen; the checkpoint makes it safe to restart.
    """
    late = F.unix_micros(F.col(time)) - F.unix_micros(F.col(mark))
    due = scored.where((late >= 0) & (late < max_late_min * 60_000_000))
    return due.withWatermark(time, forget).dropDuplicatesWithinWatermark(list(key))


def grid_counts(rows: DataFrame, time: str, groups: Sequence[str], value: Column, step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and mean of a value per tumbling window, closed by the watermark."""
    return rows.withWatermark(time, late).groupBy(F.window(time, step).alias("w"), *groups).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(*groups, F.col("w.start").alias("g"), "n", "mean")


def age_status(rows: DataFrame, key: str, time: str, now: Column, degraded_s: float = 300, error_s: float = 900) -> DataFrame:
    """(key, age_s, status) by the last time of each key: ok, degraded or error."""
    last = rows.groupBy(key).agg(F.max(time).alias("_last"))
    age = (F.unix_micros(now) - F.unix_micros("_last")) / F.lit(1e6)
    status = F.when(age.isNull() | (age > error_s), "error").when(age > degraded_s, "degraded").otherwise("ok")
    return last.select(key, age.alias("age_s"), status.alias("status"))


def overall_status(ages: DataFrame) -> DataFrame:
    """One row (age_s, status): the freshest key's age and the worst status of any; error without keys."""
    worst = F.max(F.when(F.col("status") == "error", 2).when(F.col("status") == "degraded", 1).otherwise(0))
    return ages.agg(F.min("age_s").alias("age_s"), F.when(worst == 0, "ok").when(worst == 1, "degraded").otherwise("error").alias("status"))


def grid_state_stream(rows: DataFrame, plan: DataFrame, path: str, checkpoint: str, step: int = 5, every: str | None = None, keep: str = "48 hours") -> StreamingQuery:
    """Point-in-time state of the hubs at each grid time that a batch of observations completes, in `path`/n=<batch>.

    rows: key, obs, ct, cs, eva. A batch carries the last observation of each key along (under `path`-carried) if it is of the
    last `keep`, and writes hub_state() of the grid times after the newest observation before it, up to its own newest
    one. All of these times are later than what is carried, so older observations of a key cannot show.
    """
    from ..functions.times import floor_to, shifted
    from ..operators.grid import events_on_grid, hub_state

    def update(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        part = batch.select("key", "obs", "ct", "cs")
        held = part if n == 0 else spark.read.parquet(f"{path}-carried/n={n - 1}").unionByName(part)
        newest = held.agg(F.max("obs")).first()[0]
        if newest is None:
            part.write.mode("overwrite").parquet(f"{path}-carried/n={n}")
            return
        before = None if n == 0 else spark.read.parquet(f"{path}-carried/n={n - 1}").agg(F.max("obs")).first()[0]
        first = F.lit(before or batch.agg(F.min("obs")).first()[0])
        last_state(held.where(F.col("obs") >= F.lit(newest) - F.expr(f"INTERVAL {keep}")), ["key"], "obs", ["ct", "cs"]).write.mode("overwrite").parquet(f"{path}-carried/n={n}")
        grid = events_on_grid(plan, held, shifted(floor_to(first, step), step), F.lit(newest), step, back=0)  # hub_state() looks no further than `around`
        hub_state(grid).write.mode("overwrite").parquet(f"{path}/n={n}")
        drop_old_snapshots(spark, f"{path}-carried", n - 2)

    writer = rows.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upcoming(pairs: DataFrame, now: Column, low_min: float = 2, high_min: float = 65) -> DataFrame:
    """Pairs whose arrival is planned low..high minutes from now."""
    ahead = (F.unix_micros("pt_a") - F.unix_micros(now)) / F.lit(6e7)
    return pairs.withColumn("minutes_to_arrival", ahead).where((ahead >= low_min) & (ahead <= high_min))


def input_status(rows: DataFrame, polls: DataFrame, key: str, time: str, poll_time: str, max_gap_min: float = 45) -> DataFrame:
    """Adds why a row can't be scored: a_cancelled, collector_gap, dst_ambiguous, or ok."""
    seen = last_time(rows, polls, key, time, poll_time, "_poll")
    gap = (F.unix_micros(time) - F.unix_micros("_poll")) / F.lit(6e7)
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(known("a_cancelled"), "a_cancelled").when(gap.isNull() | (gap > max_gap_min), "collector_gap").when(known("ambiguous"), "dst_ambiguous").otherwise("ok")
    return seen.withColumn("status", status).drop("_poll")
