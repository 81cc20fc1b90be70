"""The store as an object: one method per verb of the API.

Reads return frames. Verbs that change the store return the frames of new row
versions and ledger rows; ``commit`` writes them as the next snapshot.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import consolidate, graph, mutations, predicates, replication, search
from stratalog.operators.ledger import effective_strength
from stratalog.tables import load

SCHEMA_VERSION = 1
REFUSED = ("supersedes", "co_recalled")


@dataclass
class Store:
    spark: SparkSession
    path: str
    now: int = field(default_factory=lambda: int(time.time()))

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.path, name)

    # reads

    def get(self, ref: str) -> DataFrame:
        """By id, full uid, or the tail of one (four characters and more); at most three rows."""
        ref = ref.split(":", 1)[-1]
        n = self.table("node")
        if ref.isdigit():
            return n.filter(F.col("id") == int(ref))
        if len(ref) < 4:
            raise ValueError("a reference needs four characters")
        hit = F.col("uid") == ref if len(ref) == 26 else F.col("uid").endswith(ref.upper())
        return n.filter(hit & predicates.live()).limit(3)

    def list(self, project: int | None = None, subkind: str | None = None, tag: str | None = None, limit: int = 50) -> DataFrame:
        c = predicates.kinds("memory") & predicates.live() & predicates.scope(project, project is None)
        if subkind:
            c = c & (F.col("subkind") == subkind)
        if tag:
            c = c & predicates.tagged(tag)
        return self.table("node").filter(c).orderBy(F.desc("created_at"), "id").limit(limit)

    def recall(self, text: str, vector: list[float] | None = None, model: str | None = None, kind: str = "all", project: int | None = None,
               as_of: int | None = None, limit: int = 8, stemmed: bool = True) -> DataFrame:
        """Hybrid page of hits with their match strength; the vector leg needs a query vector."""
        n = self.table("node")
        keep = n.filter(predicates.kinds(kind) & predicates.scope(project, project is None) & predicates.live(as_of)).select("id")
        legs = [search.leg(search.bm25(n, text, stemmed).join(keep, "id", "left_semi"))]
        if search.identifier_phrases(text):
            legs.append(search.leg(search.identifier_leg(n, text).join(keep, "id", "left_semi")))
        if vector is not None:
            v = self.table("embedding").filter((F.col("model") == model) & (F.size("vec") == len(vector))).select("node_id", "vec").distinct()
            legs.append(search.leg(search.vector_leg(v, vector).join(keep, "id", "left_semi")))
        page = search.page(search.score(search.rrf(*legs), n, as_of or self.now), limit)
        return search.match_strength(page, text, legs[0], legs[-1] if vector is not None else None)

    def brief(self, project: int | None = None) -> DataFrame:
        n = self.table("node").filter(predicates.briefable() & predicates.scope(project))
        s = F.when(F.col("pinned"), 2.0).otherwise(1.0) * (1 + 0.15 * F.ln(1 + effective_strength(self.now)))
        return n.select("id", "title", s.alias("score")).orderBy(F.desc("score"), "id")

    def callers(self, ids: list[int], depth: int = 3) -> DataFrame:
        return graph.reach(self._edges("calls"), self._ids(ids), depth, backwards=True)

    def calls(self, ids: list[int], depth: int = 3) -> DataFrame:
        return graph.reach(self._edges("calls"), self._ids(ids), depth)

    def impact(self, ids: list[int], depth: int = 3) -> DataFrame:
        return graph.reach(self._edges("calls", "imports"), self._ids(ids), depth, backwards=True)

    def path_between(self, start: int, goal: int) -> list[int] | None:
        return graph.shortest_path(self._edges("calls"), start, goal)

    def hubs(self, limit: int = 10) -> DataFrame:
        return graph.hubs(self._edges("calls"), limit)

    def communities(self, least: int = 3) -> DataFrame:
        return graph.communities(self._edges("calls"), least=least)

    def status(self) -> DataFrame:
        return self.table("node").filter(predicates.live()).groupBy("kind").agg(F.count("*").alias("n"))

    def changes(self, since: int) -> DataFrame:
        return replication.changes_since(self.table("node").filter("kind = 'memory'"), since)

    # changes

    def remember(self, items: DataFrame) -> DataFrame:
        """``items``: key, body. Status of each; texts that hold a secret are refused."""
        secret = items.filter(X.secret_kind("body").isNotNull()).select("key", F.lit("refused").alias("status"))
        clean = items.filter(X.secret_kind("body").isNull())
        return mutations.remember(self.table("node"), clean).unionByName(secret)

    def forget(self, ids: list[int]) -> DataFrame:
        return mutations.soft_delete(self.table("node"), F.col("id").isin(ids), self.now)

    def supersede(self, old: int, new: int) -> DataFrame:
        if old == new:
            raise ValueError(mutations.SELF)
        row = self.table("node").filter(F.col("id") == old).first()
        if row is not None and row["pinned"]:
            raise ValueError(mutations.PINNED)
        return mutations.supersede(self.table("node"), self.spark.createDataFrame([(old, new)], "old long, new long"), self.now)

    def edit(self, ident: int, body: str) -> tuple[DataFrame, DataFrame]:
        return mutations.edit(self.table("node"), self.spark.createDataFrame([(ident, body)], "id long, new_body string"), self.now)

    def link(self, src: int, dst: int, rel: str, weight: float = 1.0) -> DataFrame:
        if rel in REFUSED:
            raise ValueError(f"{rel} edges are not made by hand")
        new = self.spark.createDataFrame([(0, src, dst, rel, weight, "{}", self.now)], "id long, src long, dst long, rel string, weight double, meta string, created_at long")
        return graph.upsert_edges(self.table("edge").select(*new.columns).distinct(), new)

    def merge(self, incoming: DataFrame) -> DataFrame:
        return replication.apply_lww(self.table("node").filter("kind = 'memory'"), incoming)

    def consolidate(self, model: str) -> dict[str, DataFrame]:
        """What a consolidation would do; nothing is written."""
        n = self.table("node")
        good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vec", lambda x: x != 0)
        v = self.table("embedding").filter((F.col("model") == model) & (F.size("vec") == F.col("dim")) & good).select("node_id", "vec").distinct()
        m = consolidate.memory_vectors(n, v).select("id", "subkind", "project_id", "vec")
        pairs, alike = consolidate.similar_pairs(m, "project_id"), consolidate.similar_pairs(m, "subkind", "project_id")
        return {
            "duplicates": consolidate.duplicates(alike, n), "contradictions": consolidate.contradictions(alike, n),
            "clusters": consolidate.clusters(pairs), "archive": consolidate.decayed(n, self.now),
        }

    def commit(self, versions: DataFrame, target: str) -> None:
        """Writes the table after the versions to another place, ordered files by kind."""
        now = mutations.latest(self.table("node"), versions)
        now.withColumn("_schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").partitionBy("kind").parquet(target)

    def _edges(self, *rels: str) -> DataFrame:
        return self.table("edge").filter(F.col("rel").isin(*rels)).select("src", "dst").distinct()

    def _ids(self, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id long")
