"""Changes to the store as frames of new row versions; nothing is updated in place.

A version frame has the columns of ``node``; ``latest`` folds versions into the
current table. Ledgers get rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import text as X

PINNED, SELF = "a pinned row cannot be superseded", "a row cannot supersede itself"


def latest(*versions: DataFrame) -> DataFrame:
    """The newest version of each id; of equally new ones the one from the later frame."""
    out = None
    for k, v in enumerate(versions):
        v = v.withColumn("__k", F.lit(k))
        out = v if out is None else out.unionByName(v)
    w = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("__k"))
    return out.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__k")


def soft_delete(nodes: DataFrame, which: Column, now: int) -> DataFrame:
    """Deleted once only: rows already deleted keep their time."""
    hit = nodes.filter(which & F.col("deleted_at").isNull())
    return hit.withColumn("deleted_at", F.lit(now).cast("long")).withColumn("updated_at", F.lit(now).cast("long"))


def supersede(nodes: DataFrame, pairs: DataFrame, now: int) -> DataFrame:
    """``pairs``: old, new. Rows of the old ones with their successor; pinned and self pairs are refused."""
    p = pairs.filter("old <> new").select(F.col("old").alias("id"), "new")
    hit = nodes.filter(~F.coalesce("pinned", F.lit(False))).join(p, "id")
    return hit.withColumn("superseded_by", F.col("new")).withColumn("updated_at", F.lit(now).cast("long")).drop("new")


def edit(nodes: DataFrame, edits: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """``edits``: id, new_body. (new versions, revisions of the texts before)."""
    hit = nodes.join(edits, "id").filter(~F.col("new_body").eqNullSafe(F.col("body")))
    before = hit.select(F.col("id").alias("node_id"), F.lit(now).cast("long").alias("at"), "title", "body", "meta")
    new = hit.withColumn("body", F.col("new_body")).withColumn("title", X.derive_title("new_body")).withColumn("content_hash", X.content_hash("new_body"))
    return new.withColumn("updated_at", F.lit(now).cast("long")).drop("new_body"), before


def text_at(current: DataFrame, revisions: DataFrame, at: int) -> DataFrame:
    """id, body as it was at a time: the earliest revision written after it, else the current text."""
    r = revisions.filter(F.col("at") > at).groupBy("node_id").agg(F.min_by("body", "at").alias("old"), F.lit(1).alias("had"))
    j = current.join(r, F.col("id") == F.col("node_id"), "left")
    return j.select("id", F.when(F.col("had") == 1, F.col("old")).otherwise(F.col("body")).alias("body"))


def ledger(before: DataFrame, after: DataFrame, op: str, actor: str) -> DataFrame:
    """Mutation rows of memories: hashes only, never the text."""
    b = before.select("id", X.content_hash("body").alias("before_hash"))
    a = after.filter("kind = 'memory'").select("id", F.col("updated_at").alias("at"), X.content_hash("body").alias("after_hash"))
    return a.join(b, "id", "left").select("at", F.col("id").alias("node_id"), F.lit(op).alias("op"), F.lit(actor).alias("actor"), "before_hash", "after_hash")


def remember(existing: DataFrame, items: DataFrame) -> DataFrame:
    """``items``: key, body. key, status: 'duplicate' of a live memory, 'forgotten' where a
    deleted one says the same, else 'stored'; of equal items the smallest key is stored."""
    m = existing.filter("kind = 'memory'").select(X.content_hash("body").alias("h"), F.col("deleted_at").isNull().alias("live"))
    seen = m.groupBy("h").agg(F.max("live").alias("live"))
    i = items.withColumn("h", X.content_hash("body"))
    i = i.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("key"))).join(seen, "h", "left")
    status = F.when(F.col("live"), "duplicate").when(~F.col("live"), "forgotten").when(F.col("r") > 1, "duplicate").otherwise("stored")
    return i.select("key", status.alias("status"))


def put(state: DataFrame, *key: str, at: str = "at") -> DataFrame:
    """Latest value per key of an append-only key-value log."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc("id"))
    return state.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
