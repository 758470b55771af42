"""Scoring of upcoming connections, one trigger after another, from plan, carried states and a bundle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import minutes
from ..operators.asof import asof_join
from ..operators.bundle import Bundle
from ..operators.models import score_batch
from ..operators.pairs import connections
from .live import carried_state, drop_old_snapshots, upcoming

#: Of the hub's events, those planned at most so many minutes from now, and trains at least so many minutes late.
AROUND, BACK, LATE = 30, 60, 5.0


def with_states(pairs: DataFrame, states: DataFrame, side: str) -> DataFrame:
    """Adds what is known of one side of each pair: <side>_ct_cut, <side>_cs_cut."""
    known = states.select(F.col("key").alias("_k"), F.col("ct").alias(f"{side}_ct_cut"), F.col("cs").alias(f"{side}_cs_cut"))
    return pairs.join(known, F.col(f"key_{side}") == F.col("_k"), "left").drop("_k")


def live_features(pairs: DataFrame, plan: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """pairs with the features that hold now: predicted slack and delays, a known cancellation, the hub's state.

    states: key, obs, ct, cs, one row for each key with the last observation up to now; of plan only events around
    now are read. The values are those of the as-of features of the training table at t_cut = now.
    """
    rows = with_states(with_states(pairs, states, "a"), states, "b")
    a, b = F.coalesce("a_ct_cut", "pt_a"), F.coalesce("b_ct_cut", "pt_b")
    rows = rows.select(
        "*", minutes(a, F.col("pt_a")).alias("db_delay_a_min"), minutes(b, F.col("pt_b")).alias("db_delay_b_min"), minutes(b, a).alias("db_slack_min"),
        F.coalesce(F.col("b_cs_cut") == "c", F.lit(False)).cast("double").alias("b_cancel_known"), F.coalesce(F.col("a_cs_cut") == "c", F.lit(False)).alias("a_cancelled"),
    )
    age = minutes(now, F.col("pt"))
    near = plan.where((F.abs(age) <= max(AROUND, BACK)) & (F.col("first_seen") <= now)).select("eva", "key", "event", "pt", "line")
    known = near.join(states.select(F.col("key").alias("_k"), "ct", "cs"), F.col("key") == F.col("_k"), "left")
    gone = F.coalesce(F.col("cs") == "c", F.lit(False))
    delay = F.when(~gone, minutes(F.coalesce("ct", "pt"), F.col("pt")))
    hub = known.where(F.abs(age) <= AROUND).groupBy(F.col("eva").alias("_e")).agg(F.avg(gone.cast("double")).alias("hub_share_cancel"), F.avg(delay).alias("hub_mean_delay"), F.avg((delay >= LATE).cast("double")).alias("hub_share_late5"))
    lines = known.where((F.col("event") == "ar") & (age >= 0) & (age < BACK) & ~gone & F.col("line").isNotNull()).groupBy(F.col("eva").alias("_le"), F.col("line").alias("_ll")).agg(F.avg(delay).alias("line_recent_delay_a"))
    out = rows.join(hub, F.col("eva") == F.col("_e"), "left").join(lines, (F.col("eva") == F.col("_le")) & (F.col("line_a") == F.col("_ll")), "left")
    return out.drop("_e", "_le", "_ll")


def score_now(plan: DataFrame, hubs: DataFrame, states: DataFrame, polls: DataFrame, bundle: Bundle, now: Column, low_min: float = 2, high_min: float = 65, min_slack: int = 4, max_slack: int = 30, max_gap_min: float = 45) -> DataFrame:
    """Scores of the candidates that arrive low..high minutes from now, null with a status where they can't be scored.

    polls: eva, last (the last poll of each hub). Statuses, in this order: a_cancelled, collector_gap, ok.
    """
    soon = lambda m: F.timestamp_micros(F.unix_micros(now) + F.lit(int(m * 60_000_000)))
    found = connections(plan.where(F.col("first_seen") <= now), hubs, soon(low_min), soon(high_min + 1), min_slack, max_slack)
    pairs = upcoming(found, now, low_min, high_min).withColumn("key_a", F.col("trip_a").cast("long")).withColumn("key_b", F.col("trip_b").cast("long"))
    rows = live_features(pairs, plan, states, now).join(F.broadcast(polls.select(F.col("eva").alias("_p"), "last")), F.col("eva") == F.col("_p"), "left").drop("_p")
    silent = F.col("last").isNull() | (minutes(now, F.col("last")) > max_gap_min)
    rows = rows.withColumn("status", F.when(F.col("a_cancelled"), "a_cancelled").when(silent, "collector_gap").otherwise("ok")).drop("last")
    return score_batch(rows.withColumn("scored_at", now), bundle.models)


def states_at(obs: DataFrame, now: Column) -> DataFrame:
    """The last observation of each key up to now, from the whole history: what the stream carries along."""
    asked = obs.select("key").distinct().withColumn("_now", now)
    return asof_join(asked, obs, ["key"], "_now", "obs", ["ct", "cs"], tie=["ct", "cs"]).where("obs IS NOT NULL").drop("_now")


def score_stream(observations: DataFrame, plan: DataFrame, hubs: DataFrame, bundle: Bundle, path: str, checkpoint: str, every: str | None = None, keep_h: float = 48, values: Sequence[str] = ("ct", "cs"), **limits) -> StreamingQuery:
    """Scores at every trigger, as of the newest observation so far; without `every` it works off what is there and ends.

    Under `path`: states/n=<batch> (the last state of each key, of keys seen in the last keep_h hours), polls/n=<batch>
    (the last poll of each hub) and scores/n=<batch>. A batch that runs again after a failure reads the snapshots
    of the one before and overwrites its own; older snapshots are removed. observations: key, obs, ct, cs, eva.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        part = batch.select("key", "obs", *values, "eva")
        before = part.drop("eva").limit(0) if n == 0 else spark.read.parquet(f"{path}/states/n={n - 1}")
        last_polls = part.groupBy("eva").agg(F.max("obs").alias("last"))
        if n:
            last_polls = last_polls.unionByName(spark.read.parquet(f"{path}/polls/n={n - 1}")).groupBy("eva").agg(F.max("last").alias("last"))
        last_polls.write.mode("overwrite").parquet(f"{path}/polls/n={n}")
        polls = spark.read.parquet(f"{path}/polls/n={n}")
        newest = polls.agg(F.max("last")).first()[0]
        if newest is None:
            before.write.mode("overwrite").parquet(f"{path}/states/n={n}")
            return
        now = F.lit(newest)
        carried_state(before, part, ["key"], "obs", list(values), now - F.expr(f"INTERVAL {int(keep_h * 3600)} SECONDS")).write.mode("overwrite").parquet(f"{path}/states/n={n}")
        states = spark.read.parquet(f"{path}/states/n={n}")
        score_now(plan, hubs, states, polls, bundle, now, **limits).write.mode("overwrite").parquet(f"{path}/scores/n={n}")
        for kind in ("states", "polls"):
            drop_old_snapshots(spark, f"{path}/{kind}", n - 2)

    writer = observations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
