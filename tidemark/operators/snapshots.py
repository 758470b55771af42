"""The latest known value of each column, kept up by snapshots: a reader takes one snapshot and the dates after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def version_pairs(rows: DataFrame, key: Sequence[str], time: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """For each key and column the pair (when, value) of its last value that isn't null, and first_seen. Pairs of parts merge by maximum.

    Of values at one time the one with the larger `tie` counts, then the larger value.
    """
    order = [F.col(time).alias("_t"), *[F.col(t).alias(f"_o{i}") for i, t in enumerate(tie)]]
    pair = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("value"))))
    return rows.groupBy(*key).agg(*[pair(c).alias(c) for c in columns], F.min(time).alias("first_seen"))


def merged_pairs(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The pairs of both tables together."""
    return a.unionByName(b).groupBy(*key).agg(*[F.max(c).alias(c) for c in columns], F.min("first_seen").alias("first_seen"))


def values_of(pairs: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The values alone, in the form of asof.latest_version()."""
    return pairs.select(*key, *[F.col(f"{c}.value").alias(c) for c in columns], "first_seen")


def last_snapshot(spark: SparkSession, path: str, before: str) -> str | None:
    """The day of the last snapshot before a day, told from folder names."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return None
    # a folder without its marker is the rest of a write that failed
    days = [s.getPath().getName().removeprefix("as_of=") for s in store.listStatus(root) if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((d for d in days if d < before), default=None)


def _since(log: DataFrame, path: str, day: str, upto: Column, key: Sequence[str], time: str, columns: Sequence[str], tie: Sequence[str]) -> DataFrame:
    spark = log.sparkSession
    base = last_snapshot(spark, path, day)
    new = log.where((F.col("date") <= F.lit(day).cast("date")) & upto)
    if base is None:
        return version_pairs(new, key, time, columns, tie)
    pairs = version_pairs(new.where(F.col("date") > F.lit(base).cast("date")), key, time, columns, tie)
    return merged_pairs(spark.read.schema(pairs.schema).parquet(f"{path}/as_of={base}"), pairs, key, columns)


def write_snapshot(log: DataFrame, path: str, day: str, key: Sequence[str], time: str, columns: Sequence[str], tie: Sequence[str] = ()) -> None:
    """Writes the pairs of all rows up to and with a day, from the snapshot before it and the dates since.

    log: the stored table, partitioned by `date`, the day of `time`. Run again for a day it writes the same; rows that
    come to a date after its snapshot need the snapshots from that day on written again, the oldest first.
    """
    _since(log, path, day, F.lit(True), key, time, columns, tie).write.mode("overwrite").parquet(f"{path}/as_of={day}")


def latest_at(log: DataFrame, path: str, t: Column, day: str, key: Sequence[str], time: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """latest_version() of all rows up to a time t of a day, from the last snapshot before that day and the dates since; without a snapshot from all dates."""
    return values_of(_since(log, path, day, F.col(time) <= t, key, time, columns, tie), key, columns)
