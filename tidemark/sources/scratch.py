"""A place on the cluster's shared store for tables that a query reads more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a temporary folder in local mode, else the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local["):
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """The rows, written once and read from there, so that no later step makes them again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
