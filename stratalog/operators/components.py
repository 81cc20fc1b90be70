"""Connected components of an edge list by alternating large-star and small-star steps.

Each step is one grouped minimum (combined on the map side) and one join, so no
neighbourhood is ever gathered into a task; a hub's rows are split by the
adaptive skew join. The number of rounds grows with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    m = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(m, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(m.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(spark, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``edges``: columns a, b of one type. Returns id, component (its least id).

    Only ids with an edge appear; self-loops alone give the id itself; repeated
    and reversed edges count once; no edges give no rows. Labels that still change
    after ``max_rounds`` are an error, never a result.
    """
    s = Scratch(spark, "components")
    cur = s.keep(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "edges")
    loops = cur.filter("a = b").select(F.col("a").alias("id"))
    e, before = cur.filter("a <> b"), None
    for i in range(max_rounds):
        e = s.keep(_small_star(_large_star(e)).distinct(), f"round_{i}")
        state = e.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")
        ).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        if i > 1:
            s.drop(f"round_{i - 2}")
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    labels = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    known = labels.union(roots)
    alone = loops.distinct().join(known, "id", "left_anti").select("id", F.col("id").alias("component"))
    return known.union(alone).distinct()
