"""Streams with one stored state a key: last states, station ages, outcomes of predictions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

#: States go to RocksDB, whose checkpoints hold what a batch changed, not all keys. The tables of a join of streams share one
#: store a partition (format 3), in the place of four.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def start_stored(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts a stream with stored states into Parquet files; without `every` it works off what is there and ends."""
    spark = rows.sparkSession
    earlier = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:  # a stream keeps the settings that it starts with
        writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        for k, v in earlier.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _ordered(state: tuple) -> tuple:
    """Nulls before all values, as in a struct's order."""
    return tuple((v is not None, v) for v in state)


def _plain(values: tuple) -> tuple:
    return tuple(None if v is None or v is pd.NaT or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v for v in values)


class _LastState(StatefulProcessor):
    """The greatest (time, values) of a key. Emits it when it changes, and a row marked `gone` when the key is forgotten."""

    def __init__(self, key: Sequence[str], columns: Sequence[str], schema: str, keep_ms: int) -> None:
        self.key, self.columns, self.schema, self.keep_ms = list(key), list(columns), schema, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def _row(self, key: tuple, state: tuple, gone: bool) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in zip([*self.key, *self.columns, "gone"], [*key, *state, gone], strict=True)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stored = self.last.get() if self.last.exists() else None
        best = None if stored is None else _plain(tuple(stored))
        first = best
        for part in rows:
            for row in part[self.columns].itertuples(index=False, name=None):
                state = _plain(row)
                if best is None or _ordered(state) > _ordered(best):
                    best = state
        if best is not None and best != first:
            self.last.update(best)
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(best[0] // 1000 + self.keep_ms)
            yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = _plain(tuple(self.last.get()))
        self.last.clear()
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


def last_states(rows: DataFrame, key: Sequence[str], time: str, values: Sequence[str], keep: str = "48 hours") -> DataFrame:
    """A stream of (key, time, values, gone): each key's last state whenever it changes.

    The state of a key is one stored value; a batch touches, and checkpoints, only the keys that it brings, however many
    are stored. A row older than the stored one changes nothing. A key whose last time the watermark (the newest time less
    `keep`) has left behind by `keep` is forgotten, with a row marked gone; rows older than the watermark are late and dropped.
    Equal times are ordered by the values, nulls first. Rows without time are left out.
    """
    spark = rows.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    times = [c for c in (time, *values) if kinds[c] in ("timestamp", "timestamp_ntz")]
    seconds = spark.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {keep}")) / 1000).cast("long")).first()[0]
    marked = rows.where(F.col(time).isNotNull()).select(*key, *[F.col(c) for c in (time, *values)]).withColumn("_w", F.col(time)).withWatermark("_w", keep)
    for c in times:
        marked = marked.withColumn(c, F.unix_micros(F.col(c).cast("timestamp")))
    held = ", ".join(f"`{c}` {'bigint' if c in times else kinds[c]}" for c in (time, *values))
    out = ", ".join([*[f"`{k}` {kinds[k]}" for k in key], held, "gone boolean"])
    told = marked.groupBy(*key).transformWithStateInPandas(statefulProcessor=_LastState(key, [time, *values], held, seconds), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return told.select(*key, *[F.timestamp_micros(c).cast(kinds[c]).alias(c) if c in times else F.col(c) for c in (time, *values)], "gone")


def read_states(spark: SparkSession, path: str, key: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """The states as they stand after the batches written so far: the last row of each key, without those forgotten since."""
    last = F.max(F.struct(time, "gone", *values)).alias("_s")
    return spark.read.parquet(path).groupBy(*key).agg(last).where("NOT _s.gone").select(*key, F.col(f"_s.{time}").alias(time), *[F.col(f"_s.{v}").alias(v) for v in values])


class _Age(StatefulProcessor):
    """A key's last time and status; timers tell when silence makes it degraded and then an error."""

    def __init__(self, key: str, time: str, limits_ms: tuple[int, int]) -> None:
        self.key, self.time, self.limits = key, time, limits_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long, status string")

    def _told(self, key: tuple, t: int, now: int) -> Iterator[pd.DataFrame]:
        age = now - t
        status = "error" if age > self.limits[1] else "degraded" if age > self.limits[0] else "ok"
        if not self.last.exists() or self.last.get()[1] != status:
            yield pd.DataFrame({self.key: [key[0]], "status": [status], "age_ms": [age], "at_ms": [now]})
        self.last.update((t, status))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if status != "error":
            self.handle.registerTimer(t + self.limits[status == "degraded"] + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest = max(int(part[self.time].max()) for part in rows)
        if self.last.exists():
            newest = max(newest, int(self.last.get()[0]))
        yield from self._told(key, newest, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._told(key, int(self.last.get()[0]), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def age_statuses(rows: DataFrame, key: str, time: str, degraded_s: float = 300, error_s: float = 900) -> DataFrame:
    """A stream of (key, status, age_ms, at_ms): each change of a key's data-age status, those by silence included.

    Nothing needs to arrive: timers of the running stream's clock tell when the last time of a key is too old. To be started
    with a trigger interval, which bounds how late a change is told. Rows without key or time are left out.
    """
    kind = rows.schema[key].dataType.simpleString()
    known = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.unix_millis(F.col(time).cast("timestamp")).alias(time))
    limits = int(degraded_s * 1000), int(error_s * 1000)
    return known.groupBy(key).transformWithStateInPandas(statefulProcessor=_Age(key, time, limits), outputStructType=f"`{key}` {kind}, status string, age_ms long, at_ms long", outputMode="Append", timeMode="ProcessingTime")


def online_outcomes(predictions: DataFrame, labelled: DataFrame, key: Sequence[str], scored: str, known: str, horizon: str, late: str = "1 hour", eligible: Column | None = None) -> DataFrame:
    """Streamed predictions with their outcomes: evaluated, excluded, or not_a_candidate once no label can come any more.

    A label counts from its prediction's time to `horizon` after it. Both streams are kept as long as the other may still
    match, `late` being how much out of order they run; a prediction without label is told when the watermark has
    passed its horizon. labelled brings key, `known` (its time) and its other columns; eligible is a condition on them.
    """
    renamed = labelled.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[c for c in labelled.columns if c not in key]).withWatermark(known, late)
    own = predictions.withWatermark(scored, late)
    on = (F.col(known) >= F.col(scored)) & (F.col(known) <= F.col(scored) + F.expr(f"INTERVAL {horizon}"))
    for i, k in enumerate(key):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    joined = own.join(renamed, on, "leftOuter")
    fine = F.coalesce(F.col("eligible") if eligible is None else eligible, F.lit(False))
    kind = F.when(F.col("_k0").isNull(), "not_a_candidate").when(fine, "evaluated").otherwise("excluded")
    return joined.withColumn("outcome", kind).drop(*[f"_k{i}" for i in range(len(key))])
