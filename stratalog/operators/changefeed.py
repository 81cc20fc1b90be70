"""Applying a feed of inserts, updates and deletes to a keyed table.

The order of the changes is that of their stamps, never that of their arrival.
Changes are ranked per key and only the first survives. The rank filter is one
that the planner pushes below the exchange (a group limit on the map side), so
each map task ships one row per key at most and a hot key cannot swamp a task.

Defined cases: a change sent twice ties with itself and wins once; a null stamp
is older than any stamp; a null or blank key is ignored; an empty feed leaves
the base as it is; columns beyond the named ones travel along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.tables import clean_uid, load


def rank_changes(changes: DataFrame, key, stamp, tombstone, seq) -> DataFrame:
    """The winning change per key.

    ``key``, ``stamp``, ``tombstone`` and ``seq`` are columns: the greatest
    stamp wins, of equal ones a tombstone, then the smallest ``seq``. The result
    has the columns of ``changes`` plus ``__key`` and ``__dead``.
    """
    c = changes.select("*", key.alias("__key"), stamp.alias("__stamp"), tombstone.alias("__dead"), seq.alias("__seq"))
    c = c.filter(F.col("__key").isNotNull())
    w = Window.partitionBy("__key").orderBy(
        F.col("__stamp").desc_nulls_last(), F.col("__dead").desc(), F.col("__seq").asc_nulls_last()
    )
    return c.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank", "__stamp", "__seq")


def sync_changes(records: DataFrame) -> DataFrame:
    """Winning change per uid of the ``sync_record`` feed, tombstones included."""
    return rank_changes(
        records,
        clean_uid("uid"),
        F.greatest("updated_at", "deleted_at"),
        F.col("deleted_at").isNotNull(),
        F.col("feed_id"),
    )


def apply_feed(changes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The table after the feed: live rows, one per uid.

    ``base`` has the columns of ``sync_record``; its rows take part with their
    own stamps, and with a feed_id lower than any in the feed they win ties.
    """
    merged = changes if base is None else base.unionByName(changes, allowMissingColumns=True)
    won = sync_changes(merged).filter(~F.col("__dead"))
    return won.withColumn("uid", F.col("__key")).drop("__key", "__dead")


def live_memories(spark, sf_dir: str) -> DataFrame:
    return apply_feed(load(spark, sf_dir, "sync_record"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return live_memories(spark, sf_dir).select("uid", "feed_id")


def p6_counts(spark, sf_dir: str) -> DataFrame:
    """Changes, keys, live and deleted keys per type of the winning change."""
    won = sync_changes(load(spark, sf_dir, "sync_record"))
    return won.groupBy(F.coalesce("mtype", F.lit("none")).alias("mtype")).agg(
        F.count("*").alias("keys"),
        F.sum(F.when(F.col("__dead"), 0).otherwise(1)).alias("live"),
        F.sum(F.when(F.col("__dead"), 1).otherwise(0)).alias("deleted"),
    )
