"""Connected components by contraction, with joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long): the smallest node of its component.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks once more, and
    contracts the edges; what is left are edges between hooked nodes. Minima are combined before the
    exchange, so that a node with a third of all edges is no burden. Rounds are written to the shared
    folder; their number grows with the logarithm of the longest path.
    """
    rest = materialize(_oriented(edges.select("a", "b")), "edges")
    labels = None
    k = 0
    while not rest.isEmpty():
        hook = rest.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("to"))
        hook = materialize(hook, f"hooks-{k}")
        onward = hook.select(F.col("node").alias("to"), F.col("to").alias("then"))
        jump = materialize(hook.join(onward, "to", "left").select("node", F.coalesce("then", "to").alias("to")), f"jumps-{k}")
        if labels is None:
            nodes = rest.select(F.col("hi").alias("node")).union(rest.select("lo")).distinct()
            now = nodes.join(jump, "node", "left").select("node", F.coalesce("to", "node").alias("label"))
        else:
            now = labels.join(jump.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        now = materialize(now, f"labels-{k}")
        moved = rest.join(jump.select(F.col("node").alias("hi"), F.col("to").alias("a")), "hi", "left").select(F.coalesce("a", "hi").alias("a"), "lo")
        moved = moved.join(jump.select(F.col("node").alias("lo"), F.col("to").alias("b")), "lo", "left").select("a", F.coalesce("b", "lo").alias("b"))
        left = materialize(_oriented(moved), f"edges-{k}")
        discard(rest, hook, jump, *([labels] if labels is not None else []))
        rest, labels = left, now
        k += 1
    if labels is None:
        return materialize(rest.select(F.col("hi").alias("node"), F.col("lo").alias("label")), "labels")
    discard(rest)
    return labels


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
