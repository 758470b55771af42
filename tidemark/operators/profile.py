"""Data quality and coverage profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import save
from .quantiles import beside, exact_quantiles


def null_shares(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, null_share) of all columns in one pass."""
    wide = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"_{i}") for i, c in enumerate(columns)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("null_share")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def uniqueness(rows: DataFrame, keys: dict[str, Sequence[str]], approximate: bool = False) -> DataFrame:
    """(key, rows, distinct): how far each candidate key identifies rows.

    Exact counts shuffle each key's own columns once; counted together, Spark would make a wide row a key of every row.
    """
    if approximate:
        wide = rows.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(F.struct(*c)).alias(f"_{i}") for i, c in enumerate(keys.values())])
        return wide.select("_n", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"_{i}").alias("distinct")) for i, k in enumerate(keys)])).alias("x")).select("x.key", F.col("_n").alias("rows"), "x.distinct")
    each = [rows.groupBy(*c).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct")).select(F.lit(k).alias("key"), "rows", "distinct") for k, c in keys.items()]
    return reduce(DataFrame.unionByName, each)


def shares_of(rows: DataFrame, groups: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """Share of rows that meet each condition, of those where it can be judged."""
    return rows.groupBy(*groups).agg(F.count("*").alias("rows"), *[F.avg(c.cast("double")).alias(n) for n, c in conditions.items()])


def top_k(rows: DataFrame, groups: Sequence[str], value: str, k: int) -> DataFrame:
    """The k most frequent values per group with their rank and share; ties go by value."""
    counts = rows.groupBy(*groups, value).agg(F.count("*").alias("n"))
    of = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    ranked = counts.select("*", F.row_number().over(of.orderBy(F.desc("n"), F.col(value).asc_nulls_last())).alias("rank"), (F.col("n") / F.sum("n").over(of)).alias("share"))
    return ranked.where(F.col("rank") <= k)


def distribution(rows: DataFrame, groups: Sequence[str], x: str, at: Sequence[float], exact: bool = False) -> DataFrame:
    """Count, mean and quantiles: to within a rank of 1 in 10,000 in one pass, or `exact` with linear interpolation by exact_quantiles()."""
    names = [f"p{round(q * 100):02d}" for q in at]
    if not exact:
        return rows.groupBy(*groups).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), *[F.percentile_approx(x, q, 10_000).alias(c) for q, c in zip(at, names, strict=True)])
    rows = save(rows.select(*groups, x))
    found = exact_quantiles(rows, groups, x, at).select(*groups, *[F.col("quantiles")[i].alias(c) for i, c in enumerate(names)])
    return beside(rows.groupBy(*groups).agg(F.count(x).alias("n"), F.avg(x).alias("mean")), found, groups)


def match_rate(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: left rows, and how many have a right row with their key."""
    keys = right.select(*key).distinct().withColumn("_there", F.lit(1))
    return left.join(keys, list(key), "left").agg(F.count("*").alias("rows"), F.count("_there").alias("matched"))


def preferred(rows: DataFrame, key: Sequence[str], preference: Column, tie: Sequence[str]) -> DataFrame:
    """One row per key: the one with the smallest preference."""
    w = Window.partitionBy(*key).orderBy(preference, *tie)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def closest_names(names: DataFrame, known: DataFrame, k: int = 3, within: int = 2) -> DataFrame:
    """Names that are not known, each with the k known names at the least edit distance, at most `within` edits away.

    A name that is d edits away shares at least one of d + 1 pieces into which the other is cut, at a place
    shifted by at most d. So names meet by equal pieces, not all with all, and only those are compared.
    """
    missing = names.select("name").distinct().join(known.select("name").distinct(), "name", "left_anti")
    n = within + 1
    length = F.length("name")
    bounds = [F.floor(length * i / n).cast("int") for i in range(n + 1)]
    pieces = F.array(*[F.struct(F.lit(i).alias("i"), length.alias("_l"), bounds[i].alias("_at"), F.expr("name").substr(bounds[i] + 1, bounds[i + 1] - bounds[i]).alias("piece")) for i in range(n)])
    cut = missing.select("name", F.explode(pieces).alias("_p")).select("name", "_p.*")
    other = known.select(F.col("name").alias("close")).distinct().withColumn("_cl", F.length("close"))
    # the same pieces of a known name, for each length the missing name may have and each shift of a piece
    lengths = other.withColumn("_l", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_cl") - within), F.col("_cl") + within)))
    placed = lengths.select("close", "_l", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    start = F.floor(F.col("_l") * F.col("i") / n).cast("int")
    size = F.floor(F.col("_l") * (F.col("i") + 1) / n).cast("int") - start
    shifts = placed.withColumn("_s", F.explode(F.sequence(F.greatest(F.lit(0), start - within), start + within)))
    parts = shifts.select("close", "_l", "i", F.col("close").substr(F.col("_s") + 1, size).alias("piece")).distinct()
    pairs = cut.join(parts, ["_l", "i", "piece"]).select("name", "close").distinct().withColumn("distance", F.levenshtein("name", "close")).where(F.col("distance") <= within)
    w = Window.partitionBy("name").orderBy("distance", "close")
    found = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return missing.join(found, "name", "left").select("name", "close", "distance", "rank")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by the smallest MD5s of seed and key: the same ones each time, in any engine."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), key).limit(n)


def partial_correlation(rows: DataFrame, x: str, y: str, given: Sequence[str]) -> DataFrame:
    """Correlation of x and y beyond `given`; a missing covariate counts as its mean, with an indicator.

    One pass for the means and one for all sums of products; the small system is solved on the driver. One row.
    """
    import numpy as np

    spark = rows.sparkSession
    means = rows.agg(F.count("*"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(given)]).first()[1:]
    cov: list[Column] = [F.lit(1.0)]
    for i, c in enumerate(given):
        cov += [F.coalesce(F.col(c), F.lit(means[i] or 0.0)).cast("double"), F.col(c).isNull().cast("double")]
    full = [*cov, F.col(x).cast("double"), F.col(y).cast("double")]
    n = len(full)
    sums = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(*[F.sum(full[i] * full[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    s = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            s[i, j] = s[j, i] = sums[f"s{i}_{j}"] or 0.0
    k = len(cov)
    solved = np.linalg.lstsq(s[:k, :k], s[:k, k:], rcond=None)[0]
    rest = s[k:, k:] - s[:k, k:].T @ solved
    r = rest[0, 1] / np.sqrt(rest[0, 0] * rest[1, 1]) if rest[0, 0] > 1e-12 and rest[1, 1] > 1e-12 else None
    return spark.createDataFrame([(int(s[0, 0]), None if r is None else float(r))], "n long, partial_corr double")


def greedy_cover(reach: DataFrame, item: str, covered: str, weights: DataFrame, k: int) -> DataFrame:
    """k picks of `item`, each adding the most weight not yet covered: (pick, item, added, share).

    reach: (item, covered); weights: (covered, weight). One aggregation a pick; what is left is written
    after each. Only the k picks come to the driver.
    """
    spark = reach.sparkSession
    total = weights.agg(F.sum("weight")).first()[0] or 0
    left = reach.select(F.col(item).cast("string").alias("item"), F.col(covered).alias("covered")).distinct().join(weights.select(F.col(covered).alias("covered"), "weight"), "covered")
    left = save(left)
    picks, sum_ = [], 0.0
    for n in range(1, k + 1):
        best = left.groupBy("item").agg(F.sum("weight").alias("added")).orderBy(F.desc("added"), "item").first()
        if best is None:
            break
        sum_ += float(best["added"])
        picks.append((n, best["item"], float(best["added"]), sum_ / float(total)))
        left = save(left.join(left.where(F.col("item") == best["item"]).select("covered"), "covered", "left_anti"))
    return spark.createDataFrame(picks, "pick int, item string, added double, share double")
