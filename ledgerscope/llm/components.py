"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): component is the
    smallest id reachable.

    Each round takes the smallest label among the neighbours and then the
    label of that label, so long chains shrink by doubling; labels only fall
    and the loop ends when none does.  Every round is a table in the shared
    folder; a hub's neighbours meet in partial aggregates only.
    """
    edges = keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = keep(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                  .select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = (edges.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"),
                                              F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = keep(step.join(jump, "component").select("id", "old", F.least("component", "further").alias("component")), "labels")
        labels = new.select("id", "component")
        if new.where("component < old").isEmpty():
            return labels
