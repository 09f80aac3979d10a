"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quitanda.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node that has a link in ``links(a, b)``.

    Every round takes the smallest label among the neighbours and then jumps along the labels, so
    chains shorten by halves. Each round is written to the shared folder. No links: no rows.
    """
    edges = materialize(
        links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node"))
                         .agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m")))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("up"))
        target = labels.select(F.col("node").alias("up"), F.col("comp").alias("far"))
        labels = materialize(lower.join(target, "up")
                             .select("node", F.least("up", "far").alias("comp"),
                                     (F.least("up", "far") < F.col("old")).alias("moved")), "labels")
        if labels.filter("moved").isEmpty():
            return labels.select("node", "comp")
