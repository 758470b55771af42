"""Views of the driver's tables as the domain's: observations, plans, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFFS = (60, 30, 10)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with `ts` as an instant (UTC) and `hub`, one of five."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("eva", (F.col("user_id") % 5).cast("string"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, obs, ct, cs, eva: errors are cancellations, values are seconds of delay after the observation."""
    e = events(spark, sf_dir)
    ct = F.timestamp_micros((F.unix_micros("ts") + F.floor("value") * 1_000_000).cast("long"))
    return e.select(F.col("user_id").alias("key"), F.col("ts").alias("obs"), ct.alias("ct"), F.when(F.col("event_type") == "error", "c").alias("cs"), "eva")


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views arrive, purchases depart, and every fourth arriving train goes on three minutes later under the same stop.

    Paths, couplings and categories are functions of the event's number.
    """
    e = events(spark, sf_dir).where("event_type IN ('view', 'purchase')")
    n = F.col("event_id")
    name = lambda x: F.concat(F.lit("S"), x.cast("string"))
    arrives = F.col("event_type") == "view"
    goes_on = F.struct(F.lit("dp").alias("event"), F.lit(3).alias("later"))
    here = F.struct(F.when(arrives, "ar").otherwise("dp").alias("event"), F.lit(0).alias("later"))
    rows = e.withColumn("_e", F.explode(F.when(arrives & (n % 4 == 1), F.array(here, goes_on)).otherwise(F.array(here))))
    stop = lambda x: F.concat_ws("-", x.cast("string"), F.lit("1"))
    path = F.when(n % 17 == 0, None).otherwise(F.concat_ws("|", name(n % 7), name(n % 11 + 3), F.when(n % 3 == 0, name(n % 13 + 5))))
    onward = F.concat_ws("|", name(n % 5), name(n % 7 + 1), name(n % 9 + 2), name(n % 11 + 4), name(n % 13 + 1), name(n % 6 + 8))
    return rows.select(
        "eva", stop(n).alias("stop_id"), F.col("_e.event").alias("event"), F.col("user_id").cast("string").alias("trip"), F.timestamp_micros(F.unix_micros("ts") + F.col("_e.later") * 60_000_000).alias("pt"), (n % 4).cast("string").alias("pp"),
        F.when(n % 5 != 0, F.concat(F.lit("L"), (n % 6).cast("string"))).alias("line"), F.when(F.col("_e.later") > 0, onward).otherwise(path).alias("path"), F.when(n % 19 == 0, ((F.col("user_id") + 1) % 150).cast("string")).alias("wings"),
        F.when(n % 13 == 0, stop(n + 1)).alias("tra"), F.element_at(F.array(*[F.lit(c) for c in ("RE", "S", "ICE", "Bus")]), (n % 4 + 1).cast("int")).alias("cat"), n.cast("string").alias("num"),
        F.timestamp_micros(F.unix_micros("ts") - (n % 90) * 60_000_000).alias("first_seen"),
    )


def span(spark: SparkSession, sf_dir: str, share: float = 1.0) -> Column:
    """The time at which so large a share of the events' span has passed, to the microsecond."""
    low, high = events(spark, sf_dir).agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    return F.timestamp_micros(F.lit(int(low + (high - low) * share // 1))) if low is not None else F.lit(None).cast("timestamp")


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eva, hub: the keys of the regions are the hubs' numbers."""
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("eva"), F.col("r_name").alias("hub"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_model, p_base, label, day, cutoff and slices of each line item of an order."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # compare in whole numbers first, so that every engine gets the same scores
    m = (F.round(F.col("l_discount") * 100) * 7 + F.col("l_quantity") + F.col("l_linenumber") * 3) % 97
    b = (F.round(F.col("l_tax") * 100) * 11 + F.col("l_quantity")) % 89
    d = F.col("o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", ((m + 1) / 99.0).alias("p_model"), ((b + 1) / 91.0).alias("p_base"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.year(d) * 12 + F.month(d)).alias("day"), F.element_at(F.array(F.lit(60), F.lit(30), F.lit(10)), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("cutoff_min"),
        F.col("o_orderpriority").alias("priority"), F.col("l_linestatus").alias("status"), (F.col("l_quantity") > 30).cast("int").alias("flag"),
    )
