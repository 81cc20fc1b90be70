"""Hybrid retrieval: BM25, identifier phrases and vectors, fused by reciprocal rank.

A query's legs are single scans that keep the best hundred; corpus statistics
are one row. Tombstones count in the statistics, as they do in the index, and
drop out afterwards.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.functions.stem import stem, stem_udf
from stratalog.operators import predicates as P
from stratalog.operators.ledger import effective_strength, half_life
from stratalog.session import Scratch

WEIGHTS = {"title": 4.0, "body": 1.0, "path": 2.0, "tags_text": 3.0}
K1, B = 1.2, 0.75
LEG = 100
ALPHA = {"strength": 0.15, "recency": 0.012, "prior": 0.12, "code": 0.85, "impression": 0.0}
DAY = 86_400


def query_terms(text: str) -> list[str]:
    """Tokens of a query; words without meaning go unless nothing else is left."""
    t = [w for w in re.findall(r"[\w.\-]+", text.lower()) if re.search(r"[^\W_]", w)]
    kept = [w for w in t if w not in X.STOPWORDS]
    return list(dict.fromkeys(kept or t))


def content_terms(text: str) -> list[str]:
    """Tokens of a query that carry meaning; there may be none."""
    return [w for w in query_terms(text) if w not in X.STOPWORDS]


def _stem_head(s: str) -> str:
    """What every word of a stem begins with: stemming changes no more than the last two letters of what it leaves."""
    return s[: max(2, len(s) - 2)] if len(s) > 2 else s


def bm25(nodes: DataFrame, text: str, stemmed: bool = False) -> DataFrame:
    """id, score of every node that holds a term; statistics over all nodes given.

    ``stemmed`` folds accents and takes words of one stem for each other. The text is read once: each node's length
    and, where a term can be in it, the words that may be one are written to the shared folder; statistics and
    scores come from there.
    """
    terms = query_terms(X.fold_text(text) if stemmed else text)
    if stemmed:
        terms = list(dict.fromkeys(map(stem, terms)))
    if not terms:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    heads = list(dict.fromkeys(map(_stem_head, terms))) if stemmed else terms
    fits = lambda x: functools.reduce(Column.__or__, (x.startswith(h) for h in heads)) if stemmed else x.isin(*terms)
    cut = nodes.select("id", *[X.tokens(X.folded(c) if stemmed else c).alias(c) for c in WEIGHTS])
    words = cut.select("id", sum((F.size(c) for c in WEIGHTS), F.lit(0)).alias("dl"), *[F.filter(c, fits).alias(f"t_{c}") for c in WEIGHTS])
    base = words.select("id", "dl", *[F.when(F.size(f"t_{c}") > 0, F.col(f"t_{c}")).alias(f"t_{c}") for c in WEIGHTS])
    base = Scratch(nodes.sparkSession, "bm25").keep(base, "words")
    held = base.filter(" or ".join(f"t_{c} is not null" for c in WEIGHTS))
    if stemmed:
        held = held.select("id", "dl", *[stem_udf(f"t_{c}").alias(f"t_{c}") for c in WEIGHTS])
    count = lambda c, t: F.coalesce(F.size(F.filter(f"t_{c}", lambda x: x == t)), F.lit(0))
    tf = [sum((count(c, t) * w for c, w in WEIGHTS.items()), F.lit(0.0)) for t in terms]
    held = held.select("id", "dl", F.array(*tf).alias("tf")).filter(F.exists("tf", lambda x: x > 0))
    size = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    found = held.agg(*[F.count(F.when(F.col("tf")[i] > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    j = held.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(found))  # one row each
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, f = F.col(f"df{i}"), F.col("tf")[i]
        idf = F.greatest(F.ln((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return j.select("id", F.round(score, 6).alias("score"))


def leg(scored: DataFrame, most: int = LEG) -> DataFrame:
    """The best of a leg with their rank from 0."""
    top = scored.orderBy(F.desc("score"), "id").limit(most)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).cast("long"))


def identifier_phrases(text: str) -> list[str]:
    """Phrases of a query's words that look like identifiers: their runs of letters and digits, separated by blanks."""
    out = []
    for w in re.findall(r"[\w.:]+", text):
        if "::" in w or re.search(r"\w_\w|\w\.\w", w) or re.search(r"[a-z0-9][A-Z]", w):
            out.append(" ".join(re.findall(r"[^\W_]+", w.lower())))
    return list(dict.fromkeys(filter(None, out)))


def identifier_leg(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose title or body holds one of the phrases in a row; score is the number of phrases."""
    phrases = identifier_phrases(text)
    if not phrases:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.concat(X.text_of("title"), F.lit(" "), X.text_of("body")))
    # only texts with all parts of a phrase are cut into words
    may = functools.reduce(Column.__or__, (functools.reduce(Column.__and__, (F.contains(low, F.lit(w)) for w in p.split(" "))) for p in phrases))
    runs = lambda c: F.array_join(F.regexp_extract_all(F.lower(X.text_of(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    hay = F.concat(F.lit(" "), runs("title"), F.lit("  "), runs("body"), F.lit(" "))
    n = sum((F.when(hay.contains(f" {p} "), 1).otherwise(0) for p in phrases), F.lit(0))
    return nodes.select("id", F.when(may, n).otherwise(0).cast("double").alias("score")).filter("score > 0")


def cosine(vec, other) -> Column:
    """In double precision; the lengths need not be 1."""
    d = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    vec, other = F.col(vec) if isinstance(vec, str) else vec, F.col(other) if isinstance(other, str) else other
    return d(vec, other) / F.sqrt(d(vec, vec)) / F.sqrt(d(other, other))


def unit(vec) -> Column:
    vec = F.col(vec) if isinstance(vec, str) else vec
    n = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x.cast("double") / n)


def vector_leg(vectors: DataFrame, query: list[float]) -> DataFrame:
    """node_id, score over vectors (node_id, vec) of the query's length; a zero vector has no score."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vectors.filter((F.size("vec") == len(query)) & F.exists("vec", lambda x: x != 0))
    return v.select(F.col("node_id").alias("id"), F.round(cosine("vec", q), 6).alias("score"))


def rrf(*legs: DataFrame, k: int = 60) -> DataFrame:
    """id, rrf: the sum over legs of 1 / (k + rank + 1)."""
    allx = legs[0].select("id", "rank")
    for x in legs[1:]:
        allx = allx.unionAll(x.select("id", "rank"))
    return allx.groupBy("id").agg(F.sum(1.0 / (F.col("rank") + k + 1)).alias("rrf"))


def recency(now: int) -> Column:
    age = F.greatest(F.lit(now) - F.col("created_at"), F.lit(0)) / float(DAY)
    return F.when(half_life().isNull(), F.lit(1.0)).otherwise(1.0 / (1.0 + ALPHA["recency"] * F.ln(1.0 + age)))


def impression_damp(now: int, alpha: float) -> Column:
    """Down to 0.7 for what was shown ten times and never opened; fades in 30 days."""
    d = F.greatest(F.lit(now) - F.col("last_shown"), F.lit(0)) / float(DAY)
    damp = F.greatest(F.lit(0.7), 1.0 - alpha * F.pow(F.lit(2.0), -d / 30.0))
    return F.when((F.coalesce("shown", F.lit(0)) >= 10) & (F.coalesce("opened", F.lit(0)) == 0), damp).otherwise(1.0)


def score(fused: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """Fused hits with strength, recency, type and code factors; dead and superseded rows drop out here."""
    n = nodes.filter(P.live() & F.col("superseded_by").isNull())
    prior = F.when(F.col("subkind").isin("gotcha", "decision"), 1.25).otherwise(1.0)
    damp = F.when(F.col("kind").isin("symbol", "codechunk"), ALPHA["code"]).otherwise(1.0)
    s = F.col("rrf") * (1 + ALPHA["strength"] * F.ln(1 + effective_strength(now))) * recency(now) * (1 + ALPHA["prior"] * (prior - 1)) * damp
    # JSON is read of the hits only: a condition that needs both sides stays behind the join
    hits = fused.join(n, "id").filter(F.when(F.col("rrf").isNotNull(), ~P.expired(now)).otherwise(False))
    return hits.select("id", "kind", "title", "body", "tags_text", F.round(s, 8).alias("score"))


def page(scored: DataFrame, limit: int = 8) -> DataFrame:
    """Equal title and body once, the best first."""
    w = Window.partitionBy("title", "body").orderBy(F.desc("score"), "id")
    one = scored.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return one.orderBy(F.desc("score"), "id").limit(limit)


def overlap(hits: DataFrame, terms: list[str]) -> DataFrame:
    """``hits`` (title, body, tags_text) with the number of the terms they hold."""
    listed = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    hay = X.tokens(F.concat_ws(" ", X.text_of("title"), X.text_of("body"), X.text_of("tags_text")))
    return hits.withColumn("overlap", F.size(F.array_intersect(listed, hay)))


def match_strength(hits: DataFrame, text: str, words: DataFrame, near: DataFrame | None = None, top: int = 10) -> DataFrame:
    """``hits`` (kind, title, body, tags_text) with overlap and strength.

    Strong is a symbol the query names, or a hit with two of the query's words (one of a query of one) that both legs
    (id, rank) have among their first ten. Without a vector leg all words, two at least, must be in it. The rest is weak.
    """
    terms = content_terms(text)
    first = lambda x, c: x.filter(F.col("rank") < top).select("id", F.lit(True).alias(c))
    h = hits.join(first(words, "__w"), "id", "left")
    h = h.join(first(near, "__n"), "id", "left") if near is not None else h.withColumn("__n", F.lit(None).cast("boolean"))
    covers, w, n = F.col("overlap") >= min(2, len(terms)), F.col("__w").isNotNull(), F.col("__n").isNotNull()
    agrees = w & n if near is not None else w & (F.col("overlap") == len(terms)) & (F.col("overlap") >= 2)
    named = (F.col("kind") == "symbol") & F.lower(X.text_of("title")).isin(*terms)
    strong = F.lit(bool(terms)) & (named | covers & agrees)
    return overlap(h, terms).withColumn("strength", F.when(strong, "strong").otherwise("weak")).drop("__w", "__n")


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided probability of a split as uneven as this."""
    n, k = wins + losses, min(wins, losses)
    if n == 0:
        return 1.0
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
    return min(1.0, 2 * tail)


def fill_budget(rows: DataFrame, budget: int, most: int = 6) -> list[int]:
    """Ids of ``rows`` (id, score, updated_at, tokens) taken in order while they fit; a smaller one
    further down takes the place of one that does not. One small job for each of the few ids."""
    order = [F.desc("score"), F.desc("updated_at"), F.asc("id")]
    out, left, after = [], budget, F.lit(True)
    for _ in range(most):
        r = rows.filter((F.col("tokens") <= left) & after).orderBy(*order).first()
        if r is None:
            break
        out.append(r["id"])
        left -= r["tokens"]
        s, u, i = (F.lit(r[k]) for k in ("score", "updated_at", "id"))
        after = (F.col("score") < s) | ((F.col("score") == s) & ((F.col("updated_at") < u) | ((F.col("updated_at") == u) & (F.col("id") > i))))
    return out
