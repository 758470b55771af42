"""From raw documents to packed training sequences, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import save, table

#: (name, function); a function takes (spark, docs, sf_dir).
STAGES = [
    ("quality classifier", stages.classify),
    ("MinHash near-dedup", stages.deduplicate),
    ("PII", stages.sanitise),
    ("mixing sources to target weights", stages.mix),
    ("best-fit packing", stages.pack),
]

#: A trained classifier, a similarity join and a tokenizer are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the table documents; the result is the last one's."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
