"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.checkpoints import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected links (a, b); links may repeat.

    Each round takes the least label among a node and its neighbours and then the label of that label, so a chain
    halves and a star is done at once. Rounds go on until nothing changes; each is one job in the shared folder.
    Own and neighbours' labels meet in one aggregation, and joins are merges: small tables are not sent through the
    driver round after round."""
    known = edges.where("a is not null and b is not null")
    both = saved(known.select("a", "b").unionAll(known.select("b", "a")))
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    nothing = F.lit(None).cast(labels.schema["component"].dataType)
    while True:
        told = both.join(labels.hint("merge"), both["b"] == labels["node"]).select(F.col("a").alias("node"), F.col("component").alias("m"), nothing.alias("old"))
        own = labels.select("node", F.col("component").alias("m"), F.col("component").alias("old"))
        step = told.unionAll(own).groupBy("node").agg(F.min("m").alias("m"), F.min("old").alias("old"))
        far = labels.select(F.col("node").alias("m"), F.col("component").alias("far"))
        step = saved(step.join(far.hint("merge"), "m").select("node", "old", F.least("m", "far").alias("component")))
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return labels
