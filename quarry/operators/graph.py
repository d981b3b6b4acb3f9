"""Concept graph: adjacency, neighbours, section maps and shortest paths for batches of pairs.

Nodes are (id, label, section_id); edges are (edge_idx, src, dst, relation), in the order that ``edge_idx`` gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.tables import stored


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: (node, other, edge_idx, relation, forward)."""
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "edge_idx", "relation", F.lit(True).alias("forward"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "edge_idx", "relation", F.lit(False).alias("forward"))
    return there.unionByName(back)


def neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges at each of ``nodes`` (node), oriented away from it; a loop counts once."""
    return adjacency(edges).where(F.col("forward") | (F.col("node") != F.col("other"))).join(nodes.select("node"), "node", "left_semi")


def section_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per section, the edges with at least one end in it: (section_id, edge_idx, src, dst, relation)."""
    inside = nodes.where(F.col("section_id").isNotNull()).select(F.col("id").alias("node"), "section_id")
    return adjacency(edges).join(inside, "node").select("section_id", "edge_idx").distinct().join(edges, "edge_idx").select("section_id", "edge_idx", "src", "dst", "relation")


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, path) for pairs (pair, a, b) that are connected; path is the list of edge indexes.

    Breadth first with one row per pair and node: among shortest paths the one with the least edge list, which is the one
    that a queue over edges in order finds. Nodes with one neighbour are entered only if they are the target, so large
    fans of leaves are not expanded: their edges are looked up by both ends. An empty path joins a node to itself.
    """
    adj = adjacency(edges).where("node <> other").select("node", "other", "edge_idx")
    inner = adj.groupBy("node").agg(F.count_distinct("other").alias("degree")).where("degree > 1").select(F.col("node").alias("inner"))
    steps = stored(adj.join(inner, F.col("other") == F.col("inner"), "left").select("node", "other", "edge_idx", F.col("inner").isNotNull().alias("through")), "graph-steps")
    inward, last = steps.where("through"), steps.where("not through")
    # one table per step: plans stay small, and the walk ends when nothing new is reached
    front = stored(pairs.select("pair", "b", F.col("a").alias("at"), F.array().cast("array<long>").alias("path")), "graph-front")
    fronts = [front]
    while True:
        open_ends = front.where("at <> b")
        walked = open_ends.join(inward, F.col("at") == F.col("node")).unionByName(open_ends.join(last, (F.col("at") == F.col("node")) & (F.col("b") == F.col("other"))))
        nearest = walked.groupBy("pair", "b", F.col("other").alias("at")).agg(F.min(F.concat("path", F.array("edge_idx"))).alias("path"))
        seen = fronts[0].select("pair", "at")
        for f in fronts[1:]:
            seen = seen.unionByName(f.select("pair", "at"))
        done = fronts[0].where("at = b").select("pair")
        for f in fronts[1:]:
            done = done.unionByName(f.where("at = b").select("pair"))
        front = stored(nearest.join(seen, ["pair", "at"], "left_anti").join(done, "pair", "left_anti").select("pair", "b", "at", "path"), "graph-front")
        if front.isEmpty():
            break
        fronts.append(front)
    found = fronts[0].where("at = b").select("pair", "path")
    for f in fronts[1:]:
        found = found.unionByName(f.where("at = b").select("pair", "path"))
    return found


def path_steps(paths: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair, step, src, dst, relation, forward): the walk from a to b, in order."""
    cut = paths.select("pair", F.posexplode("path").alias("step", "edge_idx")).join(edges, "edge_idx")
    # the direction of a step follows from where the walk stands: fold over the edges of each pair
    walk = cut.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("step", "src", "dst", "relation"))).alias("e")).join(pairs.select("pair", "a"), "pair")
    start = F.struct(F.col("a").alias("at"), F.array().cast("array<boolean>").alias("out"))
    turned = F.aggregate(
        "e", start, lambda acc, e: F.struct(F.when(e["src"] == acc["at"], e["dst"]).otherwise(e["src"]).alias("at"), F.concat(acc["out"], F.array(e["src"] == acc["at"])).alias("out")), lambda acc: acc["out"]
    )
    flat = walk.withColumn("forward", turned).select("pair", F.inline(F.arrays_zip("e", "forward")))
    return flat.select(
        "pair", "e.step", F.when(F.col("forward"), F.col("e.src")).otherwise(F.col("e.dst")).alias("src"), F.when(F.col("forward"), F.col("e.dst")).otherwise(F.col("e.src")).alias("dst"), "e.relation", "forward",
    )
