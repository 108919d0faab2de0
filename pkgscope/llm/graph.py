"""Connected components of an edge table by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for edges (a, b). Each round is written and the last one's files go; nothing but a flag reaches the driver."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "m").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("higher"))
        nxt = cut(step.join(up, "low").select("node", F.least("low", "higher").alias("root"), (F.least("low", "higher") != F.col("root")).alias("moved")))
        drop_cut(labels)
        labels = nxt.select("node", "root")
        if nxt.where("moved").isEmpty():
            drop_cut(both)
            return labels
