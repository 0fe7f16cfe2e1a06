"""Connected components and pointers, in rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a, b): the least node each is
    connected to. Every round takes the least label of the neighbours and then the
    label's own label, so chains shrink fast; each round is written out, and rounds go
    on until nothing moves: a label only ever falls, so that comes. Loops and null
    ends are no edges; a repeated edge changes nothing."""
    edges = edges.where("a <> b")
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", "other").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("nextlabel"))
        step = step.join(up, "next", "left").select("node", F.least("next", "nextlabel").alias("new"), "label")
        step = cut(step.select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def followed(pointers: DataFrame) -> DataFrame:
    """(key, root): where the pointers (key, root) end. Every key points to itself or to
    another key, and never in a circle; each round doubles how far they reach."""
    roots = pointers
    while True:
        up = roots.select(F.col("key").alias("root"), F.col("root").alias("next"))
        moved = cut(roots.join(up, "root").select("key", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        roots = moved.select("key", "root")
        if moved.where("moved").isEmpty():
            return roots
