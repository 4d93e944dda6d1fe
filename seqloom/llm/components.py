"""Connected components of a table of links, in rounds of smallest labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized, with_groups


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for each node of links(a, b).

    Each node takes the smallest label next to it. Then links are drawn between labels instead of nodes, and what has
    become one label is left out, until no link is left: the links shrink fast, whatever the size of a component, and
    the rounds grow with the logarithm of a chain's length. Each round is written to the shared folder. A label that
    many nodes hold is dealt over several tasks; only whether links are left comes to the driver."""

    def drawn(edges: DataFrame) -> DataFrame:
        return materialized(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    def lowered(edges: DataFrame) -> DataFrame:
        """node and the smallest node at its edges or itself."""
        return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("low")).distinct()).groupBy("node").agg(F.min("low").alias("low"))

    links = drawn(links)
    labels = materialized(lowered(links).withColumnRenamed("low", "component"), "labels")
    step = labels.select("node", F.col("component").alias("low"))
    while True:
        at = lambda side: step.select(F.col("node").alias(side), F.col("low").alias(f"_{side}"))  # noqa: B023, E731
        links = drawn(links.join(at("a"), "a").join(at("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        if links.isEmpty():
            return labels
        step = lowered(links)
        up = step.where("low < node")
        step = materialized(step.join(up.select(F.col("node").alias("low"), F.col("low").alias("_up")), "low", "left").select("node", F.coalesce("_up", "low").alias("low")), "step")
        moved = with_groups(labels, step.where("low < node").select(F.col("node").alias("component"), "low"), "component", F.col("node")).select("node", "low")
        labels = materialized(labels.join(moved, "node", "left").select("node", F.coalesce("low", "component").alias("component")), "labels")
