"""Connected components of an undirected graph by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _followed(labels: DataFrame) -> DataFrame:
    """labels, every one of them replaced by the last one that it leads to. Paths halve
    every round; only the last table stays."""
    while True:
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = materialise(labels.join(jump, "label").select("id", F.col("label").alias("old"), F.col("further").alias("label")), "components-labels")
        changed = new.where("label <> old").limit(1).count()
        discard(labels)
        labels = new.select("id", "label")
        if not changed:
            return labels


def between_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges a < b between the labels of the ends of ``edges``, once each; ends without
    a label stand for themselves. Edges within a label go."""
    for end in ("a", "b"):
        named = labels.select(F.col("id").alias(end), F.col("label").alias(f"to_{end}"))
        edges = edges.join(named, end, "left").withColumn(f"to_{end}", F.coalesce(f"to_{end}", end))
    return edges.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()


def _relabelled(labels: DataFrame, further: DataFrame) -> DataFrame:
    """labels by the labels that ``further`` gives to them, written once; both tables go."""
    named = further.select(F.col("id").alias("label"), F.col("label").alias("least"))
    out = materialise(labels.join(named, "label", "left").select("id", F.coalesce("least", "label").alias("label")), "components-labels")
    discard(labels, further)
    return out


def least_labels(edges: DataFrame) -> DataFrame:
    """id, label for every end of ``edges`` (a, b: long): the least id reachable.

    Every end takes the least of its neighbours and itself, and labels are followed to
    their last. Edges between different labels are then edges of a smaller graph, whose
    labels are found alike; edges within a label are not met again. An end that keeps its
    label and gives it to no other has a lesser neighbour in the next graph, so two
    rounds halve the ends at least. Tables are written out, so lineage stays short."""
    both = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "components-edges")
    near = both.select(F.col("b").alias("id"), F.col("a").alias("label")).union(both.select(F.col("a").alias("id"), F.col("a").alias("label")))
    labels = _followed(materialise(near.groupBy("id").agg(F.min("label").alias("label")), "components-labels"))
    left = materialise(between_labels(both, labels), "components-left")
    if left.limit(1).count():
        labels = _relabelled(labels, least_labels(left))
    discard(both, left)
    return labels


def with_edges(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """What least_labels() gives for the edges that ``labels`` comes from and ``edges``
    together. Only edges between different labels are worked on; ``labels`` goes."""
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct().join(labels, "id", "left_anti")
    known = materialise(labels.unionByName(ends.withColumn("label", F.col("id"))), "components-known")
    further = least_labels(between_labels(edges, labels))
    discard(labels)
    return _relabelled(known, further)
