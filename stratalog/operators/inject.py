"""What may be put before an assistant unasked: relevance floor, triggers, selection, budgets, anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import search

BUDGET_CHARS = 800


def floor(hits: DataFrame, vector_leg: DataFrame, text: str) -> DataFrame:
    """Hits relevant enough: a rule or pinned, two of the query's terms, and among the ten nearest vectors where there is a vector leg."""
    terms = search.content_terms(text)
    h = search.overlap(hits, terms)
    near = vector_leg.filter("rank < 10").select("id", F.lit(True).alias("near"))
    h = h.join(near, "id", "left")
    rule = F.col("subkind").isin("gotcha", "decision") | F.coalesce("pinned", F.lit(False))
    return h.filter(F.lit(bool(terms)) & rule & (F.col("overlap") >= min(2, len(terms))) & F.coalesce("near", F.lit(False)))


def fires(phrases: str, text: str) -> F.Column:
    """Whether a phrase of the array column is in the text, or all its words of meaning are."""
    low, words = text.lower(), search.query_terms(text)
    stop = F.array(*[F.lit(w) for w in X.STOPWORDS])
    have = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")

    def one(p):
        meant = F.array_except(F.split(p, " "), stop)
        return F.contains(F.lit(low), p) | ((F.size(meant) > 0) & (F.size(F.array_except(meant, have)) == 0))

    return F.exists(phrases, one)


def select(hits: DataFrame, seen: DataFrame, limit: int = 1) -> DataFrame:
    """The best hits a session has not seen yet."""
    return hits.join(seen.select(F.col("node_id").alias("id")), "id", "left_anti").orderBy(F.desc("score"), "id").limit(limit)


def truncated(c="body") -> F.Column:
    return X.truncate_chars(c, BUDGET_CHARS)


def guard(anchored: DataFrame, target: str, seen: DataFrame) -> DataFrame:
    """``anchored``: id, anchors. The first unseen row with an anchor that matches the target or a path suffix of it."""
    parts = target.split("/")
    suffixes = ["/".join(parts[k:]) for k in range(len(parts))] + target.split()
    hit = F.lit(False)
    for s in suffixes:
        # the glob of each anchor as a pattern, its special signs quoted
        rx = F.transform("anchors", lambda a: F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace(a, r"([.^$+{}\[\]()|\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")))
        hit = hit | F.exists(rx, _likes(s))
    return anchored.filter(hit).join(seen.select(F.col("node_id").alias("id")), "id", "left_anti").orderBy("id").limit(1)


def _likes(s: str):
    return lambda r: F.regexp_like(F.lit(s), r)


def hash_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model: words hashed to signed coordinates, length 1; empty texts give zeros."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


def embed_pending(pending: DataFrame, donors: DataFrame, embedder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """``pending``: id, content_hash, body. ``donors``: content_hash, vec. Vectors of equal text are
    copied, the rest are computed in batches: node_id, vec, copied."""
    d = donors.groupBy("content_hash").agg(F.min("vec").alias("vec"))
    j = pending.join(d, "content_hash", "left")
    copied = j.filter("vec is not null").select(F.col("id").alias("node_id"), "vec", F.lit(True).alias("copied"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                yield pd.DataFrame({"node_id": part["id"].to_numpy(), "vec": list(embedder(part["body"].tolist())), "copied": False})

    fresh = j.filter("vec is null").select("id", "body").mapInPandas(run, "node_id bigint, vec array<float>, copied boolean")
    return copied.unionByName(fresh)
