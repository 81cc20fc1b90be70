"""Batch consolidation of memories by their vectors: duplicates, contradictions, clusters, decay."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import predicates as P
from stratalog.operators.components import components
from stratalog.operators.ledger import effective_strength

DUPLICATE, CONTRADICTION, CLUSTER = 0.92, 0.85, 0.80
DAY = 86_400
#: Vectors of a block.
BLOCK = 1024


def memory_vectors(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Live memories with their vectors (node_id, vec; one length, none zero)."""
    m = nodes.filter(P.live_memory())
    return m.join(vectors.select(F.col("node_id").alias("id"), "vec"), "id")


def _compare(block: pd.DataFrame) -> pd.DataFrame:
    x = np.array(block["vec"].tolist(), dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    ids, own = block["id"].to_numpy(), block["own"].to_numpy()
    i, j = block["i"].iloc[0], block["j"].iloc[0]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    out = []
    for s in range(0, len(left), 512):
        sim = np.round(x[left[s : s + 512]] @ x[right].T, 6)
        p, q = np.nonzero(sim >= CLUSTER)
        a, b = ids[left[s + p]], ids[right[q]]
        keep = a < b if i == j else np.ones(len(a), bool)
        out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": sim[p, q][keep]}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "sim": []})


def similar_pairs(vecs: DataFrame, *bucket: str) -> DataFrame:
    """Pairs a < b within a bucket with the cosine of their vectors, 0.8 and more.

    Exact, so every two vectors of a bucket are compared, in blocks: a bucket is
    cut into blocks of about a thousand vectors, and a task compares two blocks
    by one matrix product. Only similar pairs leave a task.
    """
    key = F.xxhash64(*bucket) if bucket else F.lit(0).cast("long")
    v = vecs.select(F.coalesce(key, F.lit(0)).alias("k"), *bucket, "id", "vec")
    size = v.groupBy("k", *bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    on = F.lit(True)
    for c in ("k", *bucket):
        on = on & F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}"))
    v = v.alias("v").join(size.alias("s"), on).select("v.*", "s.blocks")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tag = F.concat_ws("|", F.col("k"), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in bucket])
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    v = v.select(tag.alias("tag"), own.alias("own"), other.alias("other"), "id", "vec")
    v = v.select("tag", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "vec")
    return v.groupBy("tag", "i", "j").applyInPandas(_compare, "a bigint, b bigint, sim double")


def duplicates(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Older rows to be superseded by newer ones: older, newer. A pinned older one stays; of
    several newer ones the smallest id is taken; of equal ages the smaller id is the older."""
    n = nodes.select("id", "created_at", "pinned")
    p = pairs.filter(F.col("sim") >= DUPLICATE)
    p = p.join(n.select(F.col("id").alias("a"), F.col("created_at").alias("ca"), F.col("pinned").alias("pa")), "a")
    p = p.join(n.select(F.col("id").alias("b"), F.col("created_at").alias("cb"), F.col("pinned").alias("pb")), "b")
    first = (F.col("ca") < F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("a") < F.col("b")))
    older, newer = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    pinned = F.when(first, F.col("pa")).otherwise(F.col("pb"))
    return p.filter(~F.coalesce(pinned, F.lit(False))).groupBy(older.alias("older")).agg(F.min(newer).alias("newer"))


def contradictions(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of close memories of which one denies: a, b."""
    n = nodes.select("id", X.negated("body").alias("neg"))
    p = pairs.filter((F.col("sim") >= CONTRADICTION) & (F.col("sim") < DUPLICATE))
    p = p.join(n.select(F.col("id").alias("a"), F.col("neg").alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("neg").alias("nb")), "b")
    return p.filter("na <> nb").select("a", "b", "sim")


def clusters(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Single-link clusters of at least so many: id, component, size."""
    c = components(pairs.sparkSession, pairs.select("a", "b"))
    size = c.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return c.join(size, "component").select("id", "component", "size")


def decayed(nodes: DataFrame, now: int, idle_days: int = 90, floor: float = 0.05) -> DataFrame:
    """Ids to archive: idle, unpinned, and faded."""
    idle = F.coalesce("last_accessed", "created_at") < now - idle_days * DAY
    return nodes.filter(P.live_memory() & ~F.coalesce("pinned", F.lit(False)) & idle & (effective_strength(now) < floor)).select("id")
