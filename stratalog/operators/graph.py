"""Graph queries over edge frames: bounded walks, shortest paths, hubs, communities.

A walk joins the frontier only, never what was already seen, and writes each
step to the shared scratch folder.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.session import Scratch


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 3, backwards: bool = False) -> DataFrame:
    """``edges``: src, dst. ``seeds``: id. Returns id, distance (1 to depth), the seeds left out."""
    a, b = ("dst", "src") if backwards else ("src", "dst")
    s = Scratch(edges.sparkSession, "reach")
    step = s.keep(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct(), "edges")
    frontier = seen = s.keep(seeds.select("id", F.lit(0).alias("distance")).distinct(), "hop_0")
    for d in range(1, depth + 1):
        new = step.join(frontier.select("id"), "id", "left_semi").select(F.col("next").alias("id")).distinct()
        new = new.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(d))
        frontier = s.keep(new, f"hop_{d}")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.filter("distance > 0")


def shortest_path(edges: DataFrame, start: int, goal: int) -> list[int] | None:
    """Vertices of a shortest path, however long, of several the one with the smallest predecessors; null if there is none."""
    if start == goal:
        return [start]
    spark = edges.sparkSession
    s = Scratch(spark, "path")
    step = s.keep(edges.select("src", "dst").distinct(), "edges")
    frontier = seen = s.keep(spark.createDataFrame([(start, None)], "id long, parent long"), "hop_0")
    hops = [frontier]
    for d in itertools.count(1):  # ends when nothing new is reached
        new = step.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = s.keep(new.join(seen.select("id"), "id", "left_anti"), f"hop_{d}")
        if frontier.isEmpty():
            return None
        seen = seen.unionByName(frontier)
        hops.append(frontier)
        if d % 8 == 0:
            seen = s.keep(seen, f"seen_{d}")  # one table again
        if not frontier.filter(F.col("id") == goal).isEmpty():
            path = [goal]
            for hop in hops[:0:-1]:  # a vertex stands in the table of its distance
                path.append(hop.filter(F.col("id") == path[-1]).first()["parent"])
            return path[::-1]


def hubs(edges: DataFrame, most: int = 10) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "dst").limit(most)


def communities(edges: DataFrame, sweeps: int = 10, least: int = 3) -> DataFrame:
    """id, label by label propagation over undirected edges. All labels change at once in
    a sweep; of equally frequent labels the smallest wins; a vertex's own label counts once."""
    s = Scratch(edges.sparkSession, "labels")
    both = s.keep(edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).filter("id <> other").distinct(), "edges")
    label = s.keep(both.select("id").distinct().withColumn("label", F.col("id")), "sweep_0")
    for i in range(1, sweeps + 1):
        votes = both.join(label.select(F.col("id").alias("other"), "label"), "other").select("id", "label").unionAll(label)
        per = votes.groupBy("id", "label").agg(F.count("*").alias("n"))
        best = per.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
        new = s.keep(best, f"sweep_{i}")
        changed = new.join(label.withColumnRenamed("label", "old"), "id").filter("label <> old")
        if changed.isEmpty():
            label = new
            break
        label = new
    size = label.groupBy("label").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return label.join(size, "label").select("id", "label", "size")


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call sites (caller, callee name, file, receiver type) to symbols (id, name, file_id, qualified).

    Tiers: the receiver's type, the same file, a name unique everywhere (0.8),
    and two or three candidates sharing the weight; more resolve to nothing.
    """
    c = calls.join(symbols.select(F.col("id").alias("target"), F.col("name").alias("callee"), F.col("file_id").alias("t_file"), F.col("qualified").alias("t_q")), "callee")
    tier = F.when(F.col("receiver").isNotNull() & F.col("t_q").startswith(F.concat("receiver", F.lit("::"))), 0).when(F.col("t_file") == F.col("file_id"), 1).otherwise(3)
    c = c.withColumn("tier", tier)
    w = Window.partitionBy("caller", "callee")
    c = c.withColumn("best", F.min("tier").over(w)).filter("tier = best")
    c = c.withColumn("n", F.count("*").over(w)).filter("n <= 3 or tier < 3")
    weight = F.when(F.col("tier") < 3, 1.0 / F.col("n")).when(F.col("n") == 1, 0.8).otherwise(1.0 / F.col("n"))
    return c.select("caller", "callee", "target", "tier", F.round(weight, 6).alias("weight"))


def upsert_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """By stable_id: kept rows keep their id, vanished ones go, new ones have none yet."""
    o = old.select("stable_id", F.col("id").alias("old_id"))
    return new.select("stable_id", "signature").distinct().join(o, "stable_id", "left").select("stable_id", "signature", F.col("old_id").alias("id"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One edge per (src, dst, rel); the newest wins."""
    w = Window.partitionBy("src", "dst", "rel").orderBy(F.desc("created_at"), F.desc("id"))
    return old.unionByName(new).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
