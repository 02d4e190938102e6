"""Object graphs as nodes and edges; loops on the driver see counts only."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.stash import Stash

def reachable(edges: DataFrame, roots: DataFrame, depth: int | None = None, folded: int = 16) -> DataFrame:
    """Nodes (root, id, hops) that edges (src, dst) lead to from roots (root, id), each with its least hops. Each round joins
    only the newest nodes, and an anti-join keeps cycles out, so it ends when no node is new; with `depth`, a closure that is
    not whole after so many rounds is an error. Every `folded` rounds what is seen becomes one table, which keeps plans small."""
    stash = Stash(roots.sparkSession)
    seen = stash.put(roots.select("root", "id", F.lit(0).alias("hops")).distinct(), "seen")
    front = seen
    for k in itertools.count(1):
        step = front.join(edges, front["id"] == edges["src"]).select("root", F.col("dst").alias("id")).distinct()
        front = stash.put(step.join(seen, ["root", "id"], "left_anti").withColumn("hops", F.lit(k)), "front")
        if not front.limit(1).count():
            break
        if depth is not None and k > depth:
            raise RuntimeError(f"closure is not whole after {depth} rounds")
        seen = seen.unionByName(front)
        if k % folded == 0:
            seen = stash.put(seen, "seen")
    return seen


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (id, ...) that no root leads to."""
    alive = reachable(edges, roots.select(F.lit(0).alias("root"), "id"))
    return nodes.join(alive, "id", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose end is no node."""
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")


def sound(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, ok) with sound: whether the node and everything that edges (src, dst) lead to from it is there and ok. Failure is carried backwards from what is not,
    so each node is judged once for all that lead to it, and cycles end."""
    missing = dangling(edges, nodes).select(F.col("src").alias("id"))
    broken = nodes.filter(~F.coalesce("ok", F.lit(False))).select("id").union(missing).distinct()
    hit = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), broken.select(F.lit(0).alias("root"), "id"))
    return nodes.join(hit.select("id", F.lit(False).alias("sound")), "id", "left").withColumn("sound", F.coalesce("sound", F.lit(True)))


def cascade(edges: DataFrame, gone: DataFrame, kept_roots: DataFrame) -> DataFrame:
    """What goes when `gone` (id) goes: all that it leads to and that the kept roots don't."""
    mine = reachable(edges, gone.select(F.lit(0).alias("root"), "id")).select("id").distinct()
    theirs = reachable(edges, kept_roots.select(F.lit(0).alias("root"), "id")).select("id").distinct()
    return mine.join(theirs, "id", "left_anti")


def deduplicated(nodes: DataFrame, edges: DataFrame, rounds: int = 6) -> DataFrame:
    """(id, keep): nodes (id, body) with equal body and equal merged children are one, the smallest id; merging children can
    make parents equal, so it repeats until nothing changes, `rounds` times at most."""
    stash = Stash(nodes.sparkSession)
    keep = nodes.select("id", F.col("id").alias("keep"))
    before = None
    for _ in range(rounds):
        ends = edges.join(keep, edges["dst"] == keep["id"]).select("src", "label", F.col("keep").alias("to"))
        kids = ends.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("label", "to"))).alias("kids"))
        shape = nodes.join(kids, nodes["id"] == kids["src"], "left").select("id", F.sha2(F.concat_ws("|", F.sha2("body", 256), F.coalesce(F.to_json("kids"), F.lit(""))), 256).alias("shape"))
        least = shape.groupBy("shape").agg(F.min("id").alias("keep"))
        keep = stash.put(shape.join(least, "shape").select("id", "keep"), "keep")
        left = keep.select("keep").distinct().count()
        if left == before:
            break
        before = left
    return keep


def inherited(tree: DataFrame, attribute: str) -> DataFrame:
    """tree (id, parent, attribute) with the attribute of the nearest ancestor that has one. Each round looks twice as far up as the one before, so forty
    rounds see every ancestor there can be; what is open then stands in a cycle without the attribute, and has none."""
    stash = Stash(tree.sparkSession)
    now = tree.select("id", F.col("parent").alias("up"), F.col(attribute).alias("value"))
    for _ in range(40):
        if not now.filter("value IS NULL AND up IS NOT NULL").limit(1).count():
            break
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("value").alias("above"))
        now = stash.put(now.join(above, "up", "left").select("id", F.when(F.col("value").isNull(), F.col("next")).alias("up"), F.coalesce("value", "above").alias("value")), "up")
    return now.select("id", F.col("value").alias(attribute))
