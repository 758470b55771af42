"""Shared helpers: tables, the shared scratch folder, and ranks over a global order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Where that setting is absent: a temporary folder in local mode, else a folder of the warehouse.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if context.master.startswith("local["):
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared scratch folder and reads them back: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys with more than 1 / HOT of all rows are divided; there are fewer than HOT of them.
HOT = 1000


def join_skewed(left: DataFrame, right: DataFrame, on: Sequence[str], n: str, spread: str, how: str = "inner") -> DataFrame:
    """left joined with the one row that right has for each key, however many rows of left share a key.

    right[n] is the number of left's rows with the key. A key with more than 1 / HOT of their sum is
    divided by a hash of left[spread] into parts of about that share, and right's row goes to each
    part. Such keys are fewer than HOT, so their table (keys and numbers only) is broadcast
    whatever the size of the data. how: inner or left. Keys are not null.
    """
    total = F.broadcast(right.agg(F.sum(n).alias("_total")))
    weighed = right.crossJoin(total).withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col(n) * HOT / F.col("_total"))).cast("int")).drop("_total")
    hot = weighed.where(F.col("_parts") > 1).select(*on, "_parts")
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0)).cast("int")
    dealt = left.join(F.broadcast(hot), list(on), "left").withColumn("_part", part).drop("_parts")
    copied = weighed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copied, [*on, "_part"], how).drop("_part")


def with_group_size(rows: DataFrame, key: str, name: str, least: int, spread: str) -> DataFrame:
    """Adds the number of rows of each row's key where it exceeds `least`, else 1."""
    large = save(rows.groupBy(key).agg(F.count("*").alias(name)).where(F.col(name) > least))
    return join_skewed(rows, large, [key], name, spread, "left").withColumn(name, F.coalesce(name, F.lit(1)))


def with_rank(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds the 0-based rank of each row in its group, without one task per group.

    The rows are laid out by range over (groups, order) and written once; ranks inside a partition
    plus the row counts of the partitions before it give the rank. A group of any size spreads over
    as many partitions as it fills. The only unpartitioned window runs over one row per partition
    and group in it. Rows equal in groups and order get their ranks in any order.
    """
    spark = df.sparkSession
    laid = save(df.repartitionByRange(partitions(spark), *groups, *order).withColumn("_part", F.spark_partition_id()))
    local = laid.withColumn("_local", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)) - 1)
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = laid.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    starts = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    on: Column = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    rank = (F.col("_local") + F.col("_start")).cast("long")
    return local.join(starts, on).select(*df.columns, rank.alias(name))
