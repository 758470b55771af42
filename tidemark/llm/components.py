"""Connected components of a link table, by rounds of joins that end in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, save


def components(links: DataFrame) -> DataFrame:
    """(a, b) undirected links of long ids -> (id, root): the smallest id that each linked id reaches.

    Each round takes the least root among a node and its neighbours, then follows that root's own
    root, so chains shorten by half at least in most rounds. Minima combine before the shuffle. A node with very
    many links, and a root that very many nodes share, are join keys of their own size: both
    joins divide them into parts. Every round is written to the shared folder. Ids without links
    don't appear.
    """
    edges = save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    roots = save(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"), F.count("*").alias("degree")).withColumnRenamed("a", "id"))
    while True:
        told = roots.select(F.col("id").alias("b"), F.col("root").alias("of"), "degree")
        near = join_skewed(edges, told, ["b"], "degree", "a").groupBy("a").agg(F.min("of").alias("near"))
        least = save(roots.join(near, roots["id"] == near["a"]).select("id", "root", "degree", F.least("root", "near").alias("low")))
        shared = least.groupBy("low").agg(F.count("*").alias("n"))
        step = least.select(F.col("id").alias("_via"), F.col("low").alias("_then")).join(shared, F.col("_via") == F.col("low")).select("low", "_then", "n")
        new = save(join_skewed(least, step, ["low"], "n", "id").select("id", "degree", F.col("_then").alias("root"), (F.col("_then") != F.col("root")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("id", "root")
        roots = new.select("id", "root", "degree")
