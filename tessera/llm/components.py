"""Connected components by minimum labels with pointer jumping; every step is a join or an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, temporary


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) of the nodes of edges (a long, b long).

    Each round takes the smallest label among a node and its neighbours, then the label's own label,
    so that a chain of n nodes ends after about log n rounds. Rounds are cut by written tables.
    """
    with temporary(edges.sparkSession):
        # written before they are turned round: both directions must come from one evaluation of edges
        edges = materialize(edges.where("a <> b").select("a", "b"), f"{name}-given")
        both = materialize(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), f"{name}-edges")
        labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
        labels = materialize(labels, f"{name}-0")
        step = 0
        while True:
            step += 1
            near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
            lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            own = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
            jumped = lower.join(own, lower["label"] == own["at"], "left")
            new = materialize(jumped.select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), f"{name}-{step}")
            if new.where("label <> old").isEmpty():
                break
            labels = new.select("node", "label")
        found = materialize(new.select("node", F.col("label").alias("component")), name, outer=True)
    return found
