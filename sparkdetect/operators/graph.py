"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored


def components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, label): each node that has an edge, and the least node of its component.

    Every round takes the least label among neighbours and then the label of that label, so the number of
    rounds grows with the logarithm of a component's diameter. Each round is written to the shared folder.
    Edges with a null end are dropped. Labels only come closer to the least, so it ends.
    """
    one = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stored(one.union(one.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        # a label is always a node of the same component, so its own label only comes closer to the least
        new = stored(lower.join(jump, "mid").select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("old")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").limit(1).count() == 0:
            return labels
