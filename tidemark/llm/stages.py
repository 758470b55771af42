"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns rows with docs' columns, the last one pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import minhash, mixing, packing, pii, quality
from .common import table

#: Shingle similarity, in percent, from which documents are near duplicates here.
SIMILAR = 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line classifier scores below its threshold; keeps all without labels of both classes."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def _masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under column names that clash with none of the stages', and the new name of each column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Rows that share an id are one document, of which one row stays; blank texts are no duplicates. A row
    without id goes by an id made of its text, above all real ones.
    """
    inner, c = _masked(docs)
    made = F.xxhash64(F.coalesce(c["text"], F.lit(""))).bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    rows = inner.withColumn("_id", F.coalesce(F.col(c["doc_id"]), made))
    kept = minhash.near_duplicates(rows, SIMILAR, id_col="_id", text_col=c["text"]).where("kept")
    ids = kept.groupBy("doc_id").agg(F.count_if(F.col("n_shingles") > 0).alias("_n")).select(F.col("doc_id").alias("_kept"), "_n")
    joined = rows.join(ids, F.col("_id") == F.col("_kept"))
    if ids.where("_n > 1").isEmpty():
        return joined.select(*c.values()).toDF(*c)
    several = (F.col("_n") > 1) & (mixing.word_count(F.col(c["text"])) > 0)
    one = joined.where(several).dropDuplicates(["_id"]).select(*c.values())
    return joined.where(~several).select(*c.values()).union(one).toDF(*c)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it; n_chars follows the new text."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(out.schema["n_chars"].dataType), "n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it (0 to 2 times)."""
    inner, c = _masked(docs)
    copies = mixing.mix_sources(docs).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").cast("int").alias("_copies"))
    if copies.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1 OR _id IS NULL").isEmpty():
        joined = inner.join(copies, F.col(c["doc_id"]) == F.col("_id"))
    else:  # rows that share an id: the k-th of those alike in id, source and size takes the k-th number
        rows = inner.withColumn("_words", mixing.word_count(F.col(c["text"])))
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(c["doc_id"], c["source"], "_words").orderBy(c["text"])))
        copies = copies.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy("_copies")))
        pairs = ((c["doc_id"], "_id"), (c["source"], "_source"), ("_words", "_size"), ("_k", "_nth"))
        joined = rows.join(copies, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])
    taken = joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*c.values()).toDF(*c)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences: one row per piece with its place."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
