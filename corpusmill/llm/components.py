"""Connected components by hooking and contraction, in rounds whose tables are files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spill


def _renamed(up: DataFrame, node: str, to: str) -> DataFrame:
    return up.select(F.col("node").alias(node), F.col("to").alias(to))


def _ends(up: DataFrame) -> DataFrame:
    """The table (node, to) with each chain of hooks replaced by its end; three steps at a time, so that
    a chain's length falls to a quarter, and those of most rounds end at once."""
    while True:
        a, b, c = _renamed(up, "n2", "t2"), _renamed(up, "n3", "t3"), _renamed(up, "n4", "t4")
        far = up.join(a, F.col("to") == F.col("n2")).join(b, F.col("t2") == F.col("n3")).join(c, F.col("t3") == F.col("n4"))
        up = spill(far.select("node", F.col("t4").alias("to"), (F.col("t3") != F.col("t4")).alias("moved")))
        if up.where("moved").isEmpty():
            return up


def components(edges: DataFrame, on_round=None) -> DataFrame:
    """(node, label) for each node of `edges` (a, b); label is the least node reachable.

    A round hooks every node to its least neighbour if that is less (a grouped minimum, combined
    before the shuffle, so a node of many links is no hot group), follows the hooks to their ends and
    contracts the edges. A node that is less than all its neighbours and that none of them chose is
    next to a lesser one after the round, so two rounds at least halve the nodes: there are at most
    2 log2(nodes) rounds, whatever the order of the labels. Chains of hooks are followed in a logarithm
    of their length. The least node of a component never moves, and when no edge is left all others
    have come to it. The tables are files in the shared folder, which also keeps plans free of what
    earlier rounds knew. Nothing but counts reaches the driver. `on_round` is called with each round's
    number.
    """
    live = spill(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    steps: list[DataFrame] = []
    while not live.isEmpty():
        if on_round:
            on_round(len(steps))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to"))
        ends = _ends(up)
        steps.append(ends)
        moved = live.join(_renamed(ends, "x_node", "x_to"), F.col("a") == F.col("x_node")).join(_renamed(ends, "y_node", "y_to"), F.col("b") == F.col("y_node"))
        shrunk = spill(moved.select(F.least("x_to", "y_to").alias("a"), F.greatest("x_to", "y_to").alias("b")).where("a <> b").distinct())
        discard(live)
        live = shrunk
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    discard(live)
    out = steps.pop()
    while steps:  # from the last round, which has the fewest nodes, to the first
        step = steps.pop()
        out = step.join(_renamed(out, "l_node", "l_to"), step["to"] == F.col("l_node"), "left").select("node", F.coalesce("l_to", "to").alias("to"))
    return out.select("node", F.col("to").alias("label"))


def joined(label: DataFrame, edges: DataFrame) -> DataFrame:
    """`label` after further `edges`: components of what the edges join, which are few, are put on top."""
    a = label.select(F.col("node").alias("n1"), F.col("label").alias("l1"))
    b = label.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
    ends = edges.join(a, F.col("a") == F.col("n1"), "left").join(b, F.col("b") == F.col("n2"), "left")
    top = components(ends.select(F.coalesce("l1", "a").alias("a"), F.coalesce("l2", "b").alias("b")))
    top = spill(top.select(F.col("node").alias("t_node"), F.col("label").alias("t_label")))
    up = label.join(top, F.col("label") == F.col("t_node"), "left").select("node", F.coalesce("t_label", "label").alias("label"))
    new = top.join(label.select("node"), F.col("t_node") == F.col("node"), "left_anti")
    return spill(up.unionByName(new.select(F.col("t_node").alias("node"), F.col("t_label").alias("label"))))
