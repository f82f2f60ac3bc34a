"""Connected components by rounds of smallest labels, each round a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for each end of an edge (a, b), all long: label is the smallest id of its component.

    A round gives each node the smallest label in its neighbourhood and then the label of its label, so that long
    chains halve. Rounds end when no label changes; edges within one label are dropped on the way.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("id", "near"))
    labels = stored(both.groupBy("id").agg(F.least("id", F.min("near")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("near"), F.col("label").alias("l")), "near")
        best = near.groupBy("id").agg(F.min("l").alias("l"))
        new = labels.join(best, "id").select("id", "label", F.least("label", "l").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("l"))
        new = stored(new.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("l", "new")).alias("new")))
        changed = not new.where("label <> new").isEmpty()
        labels = new.select("id", F.col("new").alias("label"))
        if not changed:
            return labels
