"""Connected components by contraction: every round hooks each node to its least neighbour and contracts the edges.

All state lives in written tables and joins; degree does not matter, since minima are combined before they are
shuffled and joins with a table of one row per node can be split by the adaptive planner. Tables of a round go when the
next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import release, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node of ``edges``; the component is the least node that can be reached."""
    left = stored(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v"), "cc-edges")
    labels = None
    while not left.isEmpty():
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = stored(
            both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("p")), "cc-parents"
        )
        up = parent.select(F.col("u").alias("up"), F.col("p").alias("grand"))
        hooks = stored(parent.join(up, parent["p"] == up["up"]).select("u", F.col("grand").alias("p")), "cc-hooks")
        a = hooks.select(F.col("u").alias("ua"), F.col("p").alias("pa"))
        b = hooks.select(F.col("u").alias("ub"), F.col("p").alias("pb"))
        old = labels
        if old is None:
            labels = stored(hooks.select(F.col("u").alias("node"), F.col("p").alias("component")), "cc-labels")
        else:
            labels = stored(
                old.join(a, old["component"] == a["ua"], "left").select("node", F.coalesce("pa", "component").alias("component")), "cc-labels"
            )
            release(old)
        contracted = left.join(a, left["u"] == a["ua"]).join(b, left["v"] == b["ub"]).where("pa <> pb")
        # the chain from a label to its own parent must stay connected too
        chain = hooks.join(up, hooks["p"] == up["up"]).where("p <> grand").select(F.col("p").alias("u"), F.col("grand").alias("v"))
        before = left
        left = stored(contracted.select(F.col("pa").alias("u"), F.col("pb").alias("v")).unionByName(chain).distinct(), "cc-edges")
        release(before, parent, hooks)
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    release(left)
    return labels
