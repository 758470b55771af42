"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, with_rank

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space); null counts none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))).cast("long")


#: Sums that one step of the search for the level brings to the driver.
POINTS = 1000


def _level(ratios: DataFrame, budget: float, weight: float) -> float | None:
    """The level at which min(cap, level * weight) over all sources spends the budget; None if all caps together don't.

    ratios: (r, c, w), the sums of caps and weights of the sources with each cap / weight. Those below some r are at
    their caps and the others share the rest; the level is the share of the first r that it doesn't exceed. Each step
    looks at up to POINTS values of r, with the sums between them, and goes on between two of them, so
    sources may be any number.
    """
    low, spent, held = None, 0.0, 0.0
    while True:
        points = ratios.count()
        if points > POINTS:
            cuts = sorted(set(ratios.agg(F.percentile_approx("r", [k / POINTS for k in range(1, POINTS)] + [1.0], 100 * POINTS)).first()[0]))
            last = ratios.agg(F.max("r")).first()[0]
            cuts = [*[x for x in cuts if x < last], last]
            found = F.array_min(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x >= F.col("r")))
            sums = ratios.groupBy(found.alias("r")).agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.min("r").alias("first"))
        else:
            sums = ratios.withColumn("first", F.col("r"))
        at, share = low, None
        for row in sorted(sums.collect(), key=lambda x: x["r"]):
            # the last ratio of this stretch holds if all below it are capped; a stretch of one ratio is asked exactly
            own = (budget - spent) / (weight - held)
            if own <= row["first"]:
                return own
            if row["first"] < row["r"] and (budget - spent - row["c"]) <= row["r"] * (weight - held - row["w"]):
                share = row["r"]
                break
            at, spent, held = row["r"], spent + row["c"], held + row["w"]
        if share is None:
            return None
        ratios = ratios.where((F.col("r") <= share) if at is None else (F.col("r") > at) & (F.col("r") <= share))
        low = at


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> the same with `target`.

    Sources in code point order, null last, take the weights in turn and share `share` times all
    sizes; no target is above `most` times its source's size, and the excess is shared again by
    weight. That fixed point is min(cap, level * weight) for the one level that spends the budget. Sources
    may be any number: their places in the order come from range partitions, the level from sums.
    """
    rows = with_rank(sizes.select("source", "source_size", F.col("source").isNull().alias("_last")), [], ["_last", "source"], "_nth")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_nth") % len(weights) + 1).cast("int"))
    rows = save(rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    ratios = save(rows.groupBy((F.col("cap") / F.col("weight")).alias("r")).agg(F.sum("cap").alias("c"), F.sum("weight").cast("double").alias("w")))
    whole = rows.agg(F.sum("source_size").cast("double"), F.sum("weight").cast("double")).first()
    level = _level(ratios, whole[0] * share, whole[1]) if whole[1] else None
    target = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The random offset of a source, in [0, 1): a multiple of 2**-28 from the MD5 of seed and name."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(source, F.lit("\x00null")))), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document enters the mix.

    A document's expected copies are its source's target / size. Documents of a source are ordered
    by (size, id), the expected copies are summed up in that order from one random offset of the
    source, and a document is emitted once for each integer that its step crosses. Ordering by
    size keeps the words taken near the target, within about one long document. The expected
    copies of a source are all alike, so the prefix sum before the i-th document is i times their
    fractional part; whole copies are added apart, which keeps the sums exact.

    Returns doc_id, size (words), source, source_size, target, copies, taken (copies * size). Null or
    blank text: size 0. Null sources form one source, after all others. A source without words has
    target 0 and no copies. Rows equal in source, size and id may swap their copies, so reruns return
    the same rows. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"))
    ranked = with_rank(save(rows), ["source"], ["size", "doc_id"], "_rank")
    targets = save(source_targets(ranked.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights))
    targets = targets.withColumnRenamed("source", "_source")
    joined = ranked.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    expected = F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))
    joined = joined.withColumn("_e", F.when(F.col("source_size") > 0, expected).otherwise(F.lit(0.0)))
    step = F.col("_e") - F.floor("_e")
    crossed = lambda i: F.floor(offset(F.col("source"), seed) + step * i)
    copies = F.floor("_e") + F.least(F.lit(1), crossed(F.col("_rank") + 1) - crossed(F.col("_rank")))
    return joined.withColumn("copies", copies.cast("long")).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
