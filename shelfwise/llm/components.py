"""Connected components of an edge table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges(a, b)``, the label being the least node of its component.

    Each step takes the least of a node's own label, its neighbours' labels and the label of its label, so the number
    of steps grows with the logarithm of a component's width. A step is one join and one grouping: a label is asked
    like a neighbour, and the old label comes along, so nothing is joined back. The driver keeps a record of every
    task, and few exchanges bound those. Labels are stored after every step; all
    sums are map-side combined, and joins on a node with very many edges are split by adaptive execution."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        asked = both.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        answers = labels.select(F.col("node").alias("b"), F.col("label").alias("told"))
        told = asked.join(answers, "b").select("a", "told", F.lit(None).cast("long").alias("own"))
        known = told.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("told"), F.col("label").alias("own")))
        new = settle(known.groupBy(F.col("a").alias("node")).agg(F.max("own").alias("label"), F.min("told").alias("next")))
        moved = new.where("label <> next").limit(1).collect()
        labels = new.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
