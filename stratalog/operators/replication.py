"""Replication between stores: changes since a watermark, and merging them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def activity() -> F.Column:
    return F.greatest("updated_at", F.coalesce("deleted_at", F.lit(0)))


def changes_since(nodes: DataFrame, since: int) -> DataFrame:
    return nodes.filter(activity() > since)


def apply_lww(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last write wins per uid. Of equal activity a tombstone wins, then the local row.

    Local signals (strength, access_count) stay the local ones whoever wins.
    """
    a = local.withColumn("incoming", F.lit(0))
    b = incoming.withColumn("incoming", F.lit(1))
    w = Window.partitionBy("uid").orderBy(activity().desc(), F.col("deleted_at").isNotNull().desc(), F.col("incoming").asc(), F.col("id").asc())
    won = a.unionByName(b).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    own = local.groupBy("uid").agg(F.max("strength").alias("s"), F.max("access_count").alias("c"))
    won = won.join(own, "uid", "left")
    return won.withColumn("strength", F.coalesce("s", "strength")).withColumn("access_count", F.coalesce("c", "access_count")).drop("s", "c")


def cursor(batch: int, now: int, slack: int = 60) -> int:
    """Where the next pull begins, never before 0."""
    return max(0, min(batch, now) - slack)
