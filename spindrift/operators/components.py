"""Connected components by contraction to smallest neighbours, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import forget, stored

#: Pointers that are broadcast at most, by a count of them; more are joined by a shuffle, whose skew AQE splits.
SENT_ROWS = 250_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node of an edge; the component is its smallest node.

    Edges count in both directions; loops and repeated edges are allowed, edges with a null end are ignored.
    Each round hooks every node to its smallest neighbour (if smaller), follows that pointer once more, and
    contracts the edges to what still differs, so the graph shrinks from round to round. Edges and pointers are written to the
    shared folder each round and removed when the next round has what it needs; only whether an edge is left reaches the driver.
    The pointers of all rounds are followed in one plan at the end, as many joins as rounds.
    """
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    ends = lambda e: e.select("a", "b").union(e.select("b", "a"))
    first = left = stored(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    left, pointers = left.where("a <> b"), []
    while left.limit(1).count():
        hooked = stored(ends(left).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "hooks")
        small = hooked.count() <= SENT_ROWS
        sent = F.broadcast if small else (lambda x: x)  # a hub's edges then stay where they are
        further = sent(hooked.select(F.col("node").alias("label"), F.col("label").alias("next")))
        pointer = stored(hooked.join(further, "label").select(F.col("node").alias("component"), F.col("next").alias("label")), "pointers")
        forget(hooked)
        pointers.append((pointer, sent))
        to = lambda c: sent(pointer.select(F.col("component").alias(c), F.col("label").alias(f"to_{c}")))
        moved = left.join(to("a"), "a").join(to("b"), "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        before, left = left, stored(moved.where("a <> b").distinct(), "edges")
        if len(pointers) > 1:
            forget(before)
    mapping = ends(first).select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    for pointer, sent in pointers:
        mapping = mapping.join(sent(pointer), "component", "left").select("node", F.coalesce("label", "component").alias("component"))
    out = stored(mapping, "components")
    for df in (first, left, *(p for p, _ in pointers)):
        forget(df)
    return out
