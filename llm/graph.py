"""Connected components of links, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut, discard


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component of each node of links (a, b)."""
    found = contracted(links)
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    return found.join(least, "label").select("node", F.col("least").alias("label"))


def contracted(links: DataFrame) -> DataFrame:
    """(node, label): one node of the component of each node of links (a, b).

    Each round a node takes the first of its neighbours and itself, and then
    what that one takes; first is by hash, so that chains of any order of nodes
    shrink quickly. Links are then between what their ends took, and those
    within one node are gone; rounds end when none is left. What nodes take is
    found before the shuffle as far as possible, and joins on a node with very
    many links are left to the adaptive split of skewed joins.
    """
    edges = cut(_edges(links), "edges")
    labels = None
    while True:
        first = edges.select(F.col("b").alias("node"), "a").union(edges.select("a", "a")).groupBy("node").agg(F.min_by("a", F.xxhash64("a")).alias("low"))
        first = cut(first, "first")
        took = cut(first.join(first.toDF("low", "lowest"), "low").select("node", F.col("lowest").alias("label")), "took")
        at = lambda c: took.toDF(c, f"{c}_took")
        rest = cut(_edges(edges.join(at("a"), "a").join(at("b"), "b").select(F.col("a_took").alias("a"), F.col("b_took").alias("b"))), "edges")
        if labels is None:
            new = took
        else:
            new = cut(labels.join(took.toDF("label", "took"), "label", "left").select("node", F.coalesce("took", "label").alias("label")), "labels")
            discard(labels, took)
        discard(edges, first)
        labels, edges = new, rest
        if edges.isEmpty():
            discard(edges)
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, label) after more links; nodes that have no row yet are their own label. The table of the old labels goes."""
    new = cut(links.select("a", "b"), "links")
    if new.isEmpty():
        discard(new)
        return labels
    at = lambda c: labels.toDF(c, f"{c}_label")
    ends = new.join(at("a"), "a", "left").join(at("b"), "b", "left")
    found = contracted(ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    old = labels.join(found.toDF("label", "lower"), "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    out = cut(old.unionByName(found.join(labels, "node", "left_anti")), "labels")
    discard(new, labels, found)
    return out


def _edges(links: DataFrame) -> DataFrame:
    """Links once each, first by hash the first end. A hash of one long is never that of another."""
    ordered = F.xxhash64("a") < F.xxhash64("b")
    pick = lambda x, y: F.when(ordered, F.col(x)).otherwise(F.col(y))
    return links.where("a <> b").select(pick("a", "b").alias("a"), pick("b", "a").alias("b")).distinct()
