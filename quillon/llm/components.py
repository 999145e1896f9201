"""Connected components of a table of links, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Union-find over links (a, b): one row (node, comp) per node of any link, comp being the
    smallest node that can be reached. Each round hooks every node to the least label around it and
    then halves the paths to the roots, so that rounds grow with the logarithm of the longest path.
    No links: no rows. Null ends are left out."""
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), "labels")
    for _ in range(rounds):
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(seen, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        # a root that is no longer its own label takes its label's label, and so do its members
        hooked = stored(hooked, "hooked")
        over = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        jumped = hooked.join(over, "comp", "left").select("node", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "was")
        labels = stored(jumped, "labels")
        if labels.where("comp <> was").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
