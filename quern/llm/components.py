"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of ``edges`` (a, b: long).

    Each round takes the least label of the neighbours, then the label of the label, so labels
    travel twice as far in each round. Rounds are written tables; nothing comes to the driver but the
    number of labels that changed. No edges, no rows; self-loops and repeated edges do no harm.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        least = both.join(of_b, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(least, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = materialize(lower.join(up, "component").select("node", "was", F.least("component", "above").alias("component")), "labels")
        changed = jumped.filter("was <> component").limit(1).count()
        release(labels)
        labels, path = jumped.select("node", "component"), jumped._quern_path
        labels._quern_path = path
        if not changed:
            release(both)
            return labels
