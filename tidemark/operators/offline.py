"""Every feature of connections at any time, out of stored data: one way for training rows, scored rows and the check for skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import minute_mark, minutes, shifted
from . import features, grid
from .asof import asof_join

#: Message columns: side, what the messages belong to, their type, and whether they are counted or only told.
MESSAGES = {
    "n_delay_codes_a": ("a", "event", "d", "count"), "n_quality_a": ("a", "event", "q", "count"), "n_delay_codes_b": ("b", "event", "d", "count"),
    "h_notice_a": ("a", "stop", "h", "told"), "h_notice_b": ("b", "stop", "h", "told"), "c_notice_a": ("a", "stop", "c", "told"),
}


def prognosis(rows: DataFrame, obs: DataFrame, row: str) -> DataFrame:
    """Adds delays, slack, cancellation, trends and ages of both sides by t_cut, all out of one as-of pass.

    Each side of a row asks for its state at the cutoff, at the cutoff's minute mark and some minutes earlier; only
    names, keys and times travel. rows: `row` (names it), key_a, key_b, pt_a, pt_b, t_cut. obs: key, obs, ct, cs.
    Without an observation the planned time holds, ages are null. Null keys or times know nothing.
    """
    cut = F.col("t_cut")
    times = {"now": cut, "mark": minute_mark(cut), "15": shifted(cut, F.lit(-15)), "30": shifted(cut, F.lit(-30))}
    asks = [F.struct(F.lit(f"{x}:{n}").alias("ask"), F.col(f"key_{x}").alias("_key"), F.col(f"pt_{x}").alias("_pt"), t.alias("_at")) for x in "ab" for n, t in times.items() if (x, n) != ("b", "30")]
    asked = rows.select(F.col(row).alias("_row"), F.explode(F.array(*asks)).alias("_x")).select("_row", "_x.*")
    facts = obs.select(F.col("key").alias("_key"), F.col("obs").alias("_obs"), "ct", "cs")
    known = asof_join(asked, facts, ["_key"], "_at", "_obs", ["ct", "cs"], tie=["ct", "cs"])
    expected = F.coalesce("ct", "_pt")
    at = lambda ask, c: F.max(F.when(F.col("ask") == ask, c))
    late = lambda ask: at(ask, minutes(expected, F.col("_pt")))
    age = lambda x: at(f"{x}:mark", minutes(minute_mark(F.col("_at")), minute_mark(F.col("_obs")))).alias(f"age_{x}_min")
    wide = known.groupBy("_row").agg(
        late("a:now").alias("db_delay_a_min"), late("b:now").alias("db_delay_b_min"), minutes(at("b:now", expected), at("a:now", expected)).alias("db_slack_min"),
        at("b:now", F.coalesce(F.col("cs") == "c", F.lit(False))).alias("b_cancel_known"), age("a"), age("b"),
        (late("a:now") - late("a:15")).alias("trend_a_15"), (late("a:now") - late("a:30")).alias("trend_a_30"), (late("b:now") - late("b:15")).alias("trend_b_15"),
    )
    return rows.join(wide, F.col(row) == F.col("_row"), "left").drop("_row")


def notices(rows: DataFrame, event_messages: DataFrame, stop_messages: DataFrame, row: str) -> DataFrame:
    """Adds the six message columns: how many were first seen by t_cut, or whether any was; one join for both sides.

    event_messages: key, type, obs; stop_messages: stop_id, type, obs; each message once, when it was first seen. Rows of
    which nothing is known have zeros.
    """
    of = lambda df, scope, key: df.select(F.lit(scope).alias("_s"), F.col(key).cast("string").alias("_k"), "type", F.col("obs").alias("_seen"))
    types = sorted({t for _, _, t, _ in MESSAGES.values()})
    facts = of(event_messages, "event", "key").unionByName(of(stop_messages, "stop", "stop_id")).where(F.col("type").isin(*types))
    asks = [F.struct(F.lit(x).alias("side"), F.lit(s).alias("scope"), F.col(f"{c}_{x}").cast("string").alias("id")) for x in "ab" for s, c in (("event", "key"), ("stop", "stop_id"))]
    asked = rows.select(F.col(row).alias("_row"), "t_cut", F.explode(F.array(*asks)).alias("_x")).select("_row", "t_cut", "_x.*")
    met = asked.join(facts, (F.col("scope") == F.col("_s")) & (F.col("id") == F.col("_k")) & (F.col("_seen") <= F.col("t_cut")))
    counts = met.groupBy("_row").agg(*[F.count_if((F.col("side") == x) & (F.col("scope") == s) & (F.col("type") == t)).alias(f"_{n}") for n, (x, s, t, _) in MESSAGES.items()])
    out = rows.join(counts, F.col(row) == F.col("_row"), "left")
    shown = [(F.coalesce(f"_{n}", F.lit(0)) if how == "count" else (F.coalesce(f"_{n}", F.lit(0)) > 0).cast("long")).alias(n) for n, (*_, how) in MESSAGES.items()]
    return out.select(*rows.columns, *shown)


def corridors(rows: DataFrame, plan: DataFrame, feeders: DataFrame, hubs: DataFrame, lines: DataFrame, row: str) -> DataFrame:
    """Adds the states at the feeder stations on both trains' ways into the hub, where that entry of the plan was known by t_cut."""
    # the entry that was known first stands for a stop that was planned more than once
    inward = plan.where("event = 'ar'").groupBy(F.col("eva").alias("_e"), F.col("stop_id").alias("_s")).agg(F.min(F.struct("first_seen", "path")).alias("_in"))
    out = rows
    for x in "ab":
        way = inward.select("_e", "_s", F.col("_in.path").alias(f"_way_{x}"), F.col("_in.first_seen").alias(f"_known_{x}"))
        out = out.join(way, (F.col("eva") == F.col("_e")) & (F.col(f"stop_id_{x}") == F.col("_s")), "left").drop("_e", "_s")
    for x in "ab":
        out = grid.with_corridor(out, feeders, hubs, lines, row, f"_way_{x}", F.col(f"_known_{x}") <= F.col("t_cut"), suffix=x)
    return out.select(*rows.columns, "corridor_delay_a", "corridor_line_delay_a", "corridor_delay_b")


def all_features(rows: DataFrame, plan: DataFrame, obs: DataFrame, event_messages: DataFrame, stop_messages: DataFrame, feeders: DataFrame, hubs: DataFrame, lines: DataFrame, row: str = "row", holidays: Sequence[str] = ()) -> DataFrame:
    """The row's name and all columns of features.GROUPS as they could be known at its t_cut.

    rows: `row`, eva, hub, t_cut, planned_slack_min, n_stations_before_a, line_a and of both sides key, stop_id, pt, pp, segment.
    hubs, lines: states on the grid, written tables. rows should be a written table, too: each group of features joins it once.
    """
    out = prognosis(rows, obs, row)
    out = grid.with_hub_state(out, hubs, lines)
    out = corridors(out, plan, feeders, hubs, lines, row)
    out = notices(out, event_messages, stop_messages, row)
    return features.context(out, holidays).select(row, *features.feature_columns(list(features.GROUPS)))
