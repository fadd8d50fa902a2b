"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.session import discard, fresh_path, store


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (u, v)``; the root is the least node reachable.

    Each round takes the least label among neighbours and then the label of that label,
    so the longest path shrinks about threefold or better per round. Labels are written
    to the shared folder between rounds; the driver sees one count per round.
    """
    spark = edges.sparkSession
    proper = edges.where("u <> v")
    both = store(proper.select("u", "v").union(proper.select(F.col("v"), F.col("u"))).distinct(), "links")
    path = fresh_path(spark, "labels")
    first = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
    labels = store(first.select("node", F.least("node", "least").alias("root")), "labels", path=path)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("least"))
        stepped = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "least").alias("step"))
        ahead = labels.select(F.col("node").alias("step"), F.col("root").alias("beyond"))
        jumped = stepped.join(ahead, "step").select("node", "old", F.least("step", "beyond").alias("root"))
        next_path = fresh_path(spark, "labels")
        after = store(jumped, "labels", path=next_path)
        changed = after.where("root <> old").limit(1).count()
        discard(spark, path)
        labels, path = after.select("node", "root"), next_path
        if not changed:
            return labels
