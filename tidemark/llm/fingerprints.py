"""Threshold-scaled sketches of documents, in DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Words in a shingle, and the fraction of all 2**64 hashes that a sketch keeps.
WORDS, SCALE = 5, 4


def with_sketch(df: DataFrame, text: Column, name: str, scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """Adds `name`: every shingle hash of the text that is below 2**64 / scale, distinct and sorted.

    Shingles are five lower-cased words in a row; a text of fewer words is one shingle, one without
    words has none. Words are hashed once each and a shingle's hash is that of its words' hashes.
    Hashes are kept when they lie in 0 .. 2**64 / scale - 1.
    """
    limit = (1 << 64) // scale
    if limit > 1 << 63:
        raise ValueError("scale must be 2 at least")
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = df.withColumn(f"_h_{name}", F.transform(parts, lambda w: F.xxhash64(w)))
    h = F.col(f"_h_{name}")
    short = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
    shingles = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
    chosen = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < words, short).otherwise(shingles)
    kept = F.array_sort(F.array_distinct(F.filter(chosen, lambda x: (x >= 0) & (x <= limit - 1))))
    return hashed.withColumn(name, kept).drop(f"_h_{name}")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 0 where both are empty and so say nothing."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too, however unequal their sizes."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double")), F.lit(0.0))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def text_form(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(x))), ",")


def with_next(df: DataFrame, id_col: str, text_col: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Adds the columns of the next row in descending order of (id); after the last comes the first.

    Ids are cut into many buckets of about equal counts by their quantiles. Each bucket also gets
    a copy of the first row of the bucket after it (one row, marked), so that lead() inside the
    buckets sees every neighbour: texts are shuffled once and no task sees more than its buckets. Equal
    ids follow each other by text; null ids come last. Only bucket bounds come to the driver.
    """
    spark = df.sparkSession
    n = 4 * partitions(spark)
    ids = df.select(F.col(id_col).alias("i"))
    bounds = ids.agg(F.percentile_approx("i", [k / n for k in range(1, n)], 20 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    id_type = df.schema[id_col].dataType.simpleString()
    array = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<{kind}>")  # noqa: E731  one literal once folded
    table, steps = array(bounds, id_type), array([1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)], "int")

    def bucket_of(x: Column) -> Column:
        """How many bounds are below x, by bisection; -1 for null."""
        below = lambda at: F.get(table, F.least(at, F.lit(len(bounds))) - 1) < x
        found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & below(at + s), at + s).otherwise(at)) if bounds else F.lit(0)
        return F.when(x.isNull(), F.lit(-1)).otherwise(found)

    # the first id of each bucket, from the highest bucket down, and the bucket before it that gets a copy
    found = ids.groupBy(bucket_of(F.col("i")).alias("b")).agg(F.max("i").alias("first")).collect()
    heads = sorted(((r["b"], r["first"]) for r in found), reverse=True)
    before = [b for b, _ in heads[-1:] + heads[:-1]]
    null_head = df.where(F.col(id_col).isNull()).agg(F.min(F.coalesce(text_col, F.lit(""))).alias("t")).first()["t"] if heads and heads[-1][0] < 0 else None
    real = [(first, b) for (bucket, first), b in zip(heads, before, strict=True) if bucket >= 0]
    table_of_heads = spark.createDataFrame(real, f"_head {id_type}, _to int")  # at most one row a bucket
    df = df.join(F.broadcast(table_of_heads), F.col(id_col) == F.col("_head"), "left")
    to = F.col("_to")
    wrap = F.col(id_col) == F.lit(heads[0][1]) if real else F.lit(True)
    if null_head is not None:
        first_null = F.col(id_col).isNull() & (F.coalesce(text_col, F.lit("")) == F.lit(null_head))
        to, wrap = F.when(first_null, F.lit(before[-1])).otherwise(to), F.coalesce(wrap, F.lit(not real))
    own = F.struct(bucket_of(F.col(id_col)).cast("int").alias("b"), F.lit(False).alias("wrap"), F.lit(False).alias("copy"))
    copy = F.struct(to.cast("int").alias("b"), F.coalesce(wrap, F.lit(False)).alias("wrap"), F.lit(True).alias("copy"))
    spread = df.withColumn("_at", F.explode(F.when(to.isNotNull(), F.array(own, copy)).otherwise(F.array(own))))
    w = Window.partitionBy("_at.b").orderBy(F.col("_at.wrap"), F.col(id_col).desc_nulls_last(), F.coalesce(text_col, F.lit("")))
    led = spread.select("*", *[F.lead(c).over(w).alias(prefix + c) for c in columns])
    return led.where(~F.col("_at.copy")).drop("_at", "_head", "_to")


def fingerprint_documents(docs: DataFrame, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of an edited form of it, with their likeness.

    The edited text has the last third (rounded down) of its code points replaced by as many from the
    start of the next document in descending order of id. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Fingerprints are sorted hex hashes, so
    equal texts have equal ones. A null text is empty, and its fingerprint too; where both
    fingerprints are empty the likeness is 0, but 1 if the texts are equal. Very short texts may have
    an empty fingerprint, since only one hash in `scale` is kept. A single document is its own next.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    led = with_next(with_sketch(rows, F.col("text"), "sketch", scale), "doc_id", "text", ["text", "sketch"])
    n = F.length("text")
    part = F.floor(n / F.lit(3)).cast("int")
    edited = F.concat(F.expr("substring(text, 1, _n - _k)"), F.expr("substring(next_text, 1, _k)"))
    led = led.withColumn("_n", n).withColumn("_k", part).withColumn("edited", edited)
    led = with_sketch(led, F.col("edited"), "edited_sketch", scale)
    same = lambda a, b, near: F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(near)
    return led.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_form(F.col("sketch")).alias("fingerprint"),
        text_form(F.col("edited_sketch")).alias("edited_fingerprint"),
        same("text", "edited", likeness(F.col("sketch"), F.col("edited_sketch"))).alias("near_edited"),
        same("text", "next_text", likeness(F.col("sketch"), F.col("next_sketch"))).alias("near_next"),
    )
