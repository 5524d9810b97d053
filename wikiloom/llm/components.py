"""Connected components of a link table, by smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.session import WorkFolder


def components(links: DataFrame, work: WorkFolder) -> DataFrame:
    """node and label (the smallest node it is linked to, over any path) of every node in ``links`` (a, b).

    In each round a node takes the smallest label among its neighbours, and then the label of its
    label, so chains halve. Every round is written to the shared folder: nothing is recomputed when
    an executor is lost, and the plan stays short. The driver sees one count per round.
    """
    both = work.keep(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links"
    )
    labels = work.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels-0")
    turn = 0
    while True:
        turn += 1
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen, labels["node"] == seen["a"], "left").select(
            "node", "label", F.least("label", "near").alias("near")
        )
        of = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        jumped = near.join(of, "near", "left").select("node", F.col("label").alias("old"), F.least("near", "far").alias("label"))
        jumped = work.keep(jumped, f"labels-{turn}")
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels
