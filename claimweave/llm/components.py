"""Connected components of a table of edges, by lowest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id that can be reached.

    Each round takes the smallest label among neighbours, then the label's own label, so a chain's length
    shrinks by half or more. Rounds are written tables; the driver sees the number of changes only.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b"))
    both = store.write(both.distinct(), "edges")
    labels = store.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_near"))
        mine = labels.join(near, "id").select("id", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        far = labels.select(F.col("id").alias("_new"), F.col("component").alias("_far"))
        stepped = store.write(mine.join(far, "_new").select("id", "_old", F.least("_new", "_far").alias("component")), "labels")
        changed = stepped.where(F.col("_old") != F.col("component")).limit(1).count()
        store.drop(labels)
        if not changed:
            store.drop(both)
            return stepped.select("id", "component")
        labels = stepped.select("id", "component")
        labels.written_path = stepped.written_path
