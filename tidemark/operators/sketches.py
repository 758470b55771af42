"""Daily profiles of inputs as mergeable sketches: any stretch of days is told from its stored rows, not from its data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .drift import MISSING

#: Size of a quantile sketch: ranks are within 0.25 % of the truth with 99 % confidence, at about 50 kB for each day and input.
SIZE = 2_000
#: Registers of a sketch of different values, as a power of two: within 1.6 % at one standard error.
REGISTERS = 12


def daily_profiles(rows: DataFrame, day: str, numeric: Sequence[str], categorical: Sequence[str], size: int = SIZE) -> DataFrame:
    """(day, input, kind, v, rows, missing, low, high, numbers, different): what is stored of each day.

    A number has one row a day with a quantile sketch and a sketch of its different values; a category has one row a day and
    value with its count, so it should have few values. Null and NaN are missing. One pass for numbers, with
    sketches combined before the shuffle, and one aggregation for each category; rows aren't multiplied by inputs.
    """
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numeric}
    told = []
    for c, x in clean.items():
        told.append(F.struct(F.count("*").alias("rows"), F.count_if(x.isNull()).alias("missing"), F.min(x).alias("low"), F.max(x).alias("high"), F.kll_sketch_agg_double(x, size).alias("numbers"), F.hll_sketch_agg(x.cast("string"), REGISTERS).alias("different")).alias(f"_{len(told)}"))
    nothing = F.lit(None).cast("string").alias("v")
    parts = []
    if told:
        wide = rows.groupBy(F.col(day).alias("day")).agg(*told)
        items = F.array(*[F.struct(F.lit(c).alias("input"), F.lit("numeric").alias("kind"), nothing, F.col(f"_{i}").alias("_p")) for i, c in enumerate(clean)])
        parts.append(wide.select("day", F.explode(items).alias("_x")).select("day", "_x.input", "_x.kind", "_x.v", "_x._p.*"))
    for c in categorical:
        value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        counts = rows.groupBy(F.col(day).alias("day"), value.alias("v")).agg(F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("missing"))
        parts.append(counts.select("day", F.lit(c).alias("input"), F.lit("categorical").alias("kind"), "v", "rows", "missing"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merged_profiles(profiles: DataFrame, size: int = SIZE) -> DataFrame:
    """The profile of all given days together: (input, kind, v, rows, missing, low, high, numbers, different)."""
    numbers = profiles.where("kind = 'numeric'").groupBy("input", "kind", "v").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("numbers", size).alias("numbers"), F.hll_union_agg("different").alias("different")
    )
    categories = profiles.where("kind = 'categorical'").groupBy("input", "kind", "v").agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"))
    return numbers.unionByName(categories, allowMissingColumns=True)


def profile_quantiles(merged: DataFrame, at: Sequence[float]) -> DataFrame:
    """(input, quantiles) of the numbers, null where none is known."""
    known = F.col("rows") > F.col("missing")
    values = F.array(*[F.when(known, F.kll_sketch_get_quantile_double("numbers", F.lit(float(q)))) for q in at])
    return merged.where("kind = 'numeric'").select("input", values.alias("quantiles"))


def profile_edges(merged: DataFrame, bins: int = 10) -> DataFrame:
    """(input, edges): inner quantiles of each number, each once; in the form of drift.edges()."""
    found = profile_quantiles(merged, [k / bins for k in range(1, bins)])
    return found.select("input", F.array_sort(F.array_distinct(F.array_compact("quantiles"))).alias("edges"))


def profile_shares(merged: DataFrame, bounds: DataFrame) -> DataFrame:
    """(input, bin, share) for drift.psi(): of numbers by how many edges lie below the value, of categories by value; missing apart.

    A value that equals an edge is in the bin that ends there, since ranks of sketches count the values up to one.
    The edges, one row for each numeric input, are read to the driver: sketches take them as constants.
    """
    numbers = merged.where("kind = 'numeric'")
    known = F.col("rows") - F.col("missing")
    ranks = F.array(F.lit(1.0))
    for r in bounds.collect():
        ranks = F.when(F.col("input") == r["input"], F.array(*[F.kll_sketch_get_rank_double("numbers", F.lit(e)) for e in r["edges"]], F.lit(1.0))).otherwise(ranks)
    upto = F.when(known > 0, ranks)
    bins = numbers.withColumn("_u", upto).select("input", "rows", "missing", known.alias("_known"), F.posexplode_outer("_u").alias("_i", "_upto"), "_u")
    below = F.when(F.col("_i") > 0, F.col("_u")[F.col("_i") - 1]).otherwise(0.0)
    of_numbers = bins.where("_i IS NOT NULL").select("input", F.col("_i").cast("string").alias("bin"), ((F.col("_upto") - below) * F.col("_known") / F.col("rows")).alias("share"))
    of_missing = numbers.where("missing > 0").select("input", F.lit(MISSING).alias("bin"), (F.col("missing") / F.col("rows")).alias("share"))
    categories = merged.where("kind = 'categorical'")
    totals = categories.groupBy("input").agg(F.sum("rows").alias("_all"))
    return of_numbers.where("share > 0").unionByName(of_missing).unionByName(categories.join(totals, "input").select("input", F.col("v").alias("bin"), (F.col("rows") / F.col("_all")).alias("share")))
