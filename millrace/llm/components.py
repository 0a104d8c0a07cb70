"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import discard, few_tasks, staged


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, component) of every node in edges (a, b); a component is named by its smallest node.

    Each round takes the smallest label among neighbours and then the label's own label, so that a chain of n nodes needs
    about log n rounds. tasks: that write the edges at most. A node with very many neighbours is reduced in each task before its labels are shuffled.
    """
    one = edges.select("a", "b").filter("a <> b")
    both = staged(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", tasks)
    tasks = few_tasks(both)
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels", tasks)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = staged(step.join(up, "component").select("node", "old", F.least("component", "up").alias("component")), "labels", tasks)
        discard(labels)
        labels = new
        if labels.filter("old <> component").isEmpty():
            return labels.select("node", "component")
