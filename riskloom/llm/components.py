"""Connected components of a table of links, by neighbour minimum, hooking and pointer jumping.

A head learns the smallest label that any of its followers sees, so whole regions join at once
and the rounds grow with the logarithm of a path, not with its length. Every round is a few joins and aggregates over tables written to the shared folder; nothing
but one count a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written


def connected_components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """links(a, b), labels(node, label) for every node that occurs in a link; returns
    (node, label, head): the smallest label in the node's component and the node that bears it. Labels may be null (the largest).
    Labels only fall, so the rounds end by themselves when none does."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    # A state is (node, best): best is the smallest (rank, label, node) seen so far.
    best = F.struct(F.col("label").isNull().cast("int").alias("none"), F.col("label").alias("label"), F.col("node").alias("head"))
    state = written(labels.select("node", best.alias("best")), "state")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "best"), "b").groupBy("a").agg(F.min("best").alias("near"))
        seen = written(state.join(near, state["node"] == near["a"], "left").select("node", F.least("best", "near").alias("new"), F.col("best").alias("old")), "seen")
        hooks = seen.groupBy(F.col("old.head").alias("hooked")).agg(F.min("new").alias("hook"))
        step = written(seen.join(hooks, seen["node"] == hooks["hooked"], "left").select("node", F.least("new", "hook").alias("new"), "old"), "step")
        heads = step.select(F.col("node").alias("head"), F.col("new").alias("jump"))
        jumped = step.select("node", "new", "old", F.col("new.head").alias("head")).join(heads, "head", "left")
        moved = written(jumped.select("node", F.least("new", "jump").alias("best"), F.least("new", "jump").eqNullSafe(F.col("old")).alias("same")), "state")
        state = moved.select("node", "best")
        if moved.where("NOT same").limit(1).count() == 0:
            return state.select("node", F.col("best.label").alias("label"), F.col("best.head").alias("head"))
