"""Connected components by the least label, with pointer jumping; DataFrame operations only.

Labels go along edges and then to the label's own label, so the number of rounds grows with the
logarithm of a component's diameter. Each round is a table in the shared folder; none is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """((id, component) of every end of the edges (a, b), paths of the tables behind it)."""
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, edge_path = saved(both)
    labels, path = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = labels.join(near, "id").select("id", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        moved = step.join(jump, "component", "left").select("id", F.least("component", "far").alias("component"), "old")
        new, new_path = saved(moved)
        discard(spark, path)
        labels, path = new.select("id", "component"), new_path
        if new.where("component <> old").isEmpty():
            return labels, [edge_path, path]
