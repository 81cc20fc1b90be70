"""How the ledgers of the engine are read from the tables at hand, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.tables import load

#: The clock of all queries.
NOW = 1_765_000_000
DAY = 86_400


def seconds(ts) -> F.Column:
    """Unix seconds of a time without zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def recall_event(spark, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    kind = F.create_map(*[F.lit(x) for x in ("view", "shown", "click", "opened", "purchase", "useful", "error", "not_useful")])
    return e.filter("event_type <> 'signup'").select(
        F.col("event_id").alias("id"), (F.col("user_id") + 1000).alias("node_id"), kind[F.col("event_type")].alias("event"),
        F.get_json_object("props", "$.k").cast("long").alias("query_hash"), seconds("ts").alias("at"), F.col("value").alias("score"),
    )


EVENT_SQL = """ev as (select event_id as id, user_id + 1000 as node_id,
    case event_type when 'view' then 'shown' when 'click' then 'opened' when 'purchase' then 'useful' else 'not_useful' end as event,
    cast(json_extract_string(props, '$.k') as bigint) as query_hash, cast(floor(epoch(ts)) as bigint) as at, value as score
  from events where event_type <> 'signup')"""


def savings_event(spark, sf: str) -> DataFrame:
    p = F.col("l_extendedprice")
    brief = F.col("l_returnflag") == "R"
    return load(spark, sf, "lineitem").select(
        seconds("l_shipdate").alias("at"),
        F.when(brief, "brief").when(F.col("l_returnflag") == "A", "filter").otherwise("cap").alias("source"),
        F.when(brief, 0).otherwise(F.floor(p)).cast("long").alias("tokens_before"),
        F.floor(p * (1 - F.col("l_discount"))).cast("long").alias("tokens_after"),
        F.col("l_suppkey").alias("project_id"),
    )


SAVINGS_SQL = """sv as (select cast(floor(epoch(l_shipdate)) as bigint) as at, case l_returnflag when 'R' then 'brief' when 'A' then 'filter' else 'cap' end as source,
    cast(case when l_returnflag = 'R' then 0 else floor(l_extendedprice) end as bigint) as tokens_before,
    cast(floor(l_extendedprice * (1 - l_discount)) as bigint) as tokens_after, l_suppkey as project_id from lineitem)"""


def nodes(spark, sf: str, *cols: str) -> DataFrame:
    return load(spark, sf, "node").select(*cols)


def edges(spark, sf: str) -> DataFrame:
    """Edges with exact repeats once."""
    return load(spark, sf, "edge").select("id", "src", "dst", "rel", "weight", "meta", "created_at").distinct()


EDGE_SQL = "ed as (select distinct id, src, dst, rel, weight, meta, created_at from edge)"


def supersede_ledger(spark, sf: str) -> DataFrame:
    return nodes(spark, sf, "id", "created_at", "superseded_by").filter("superseded_by is not null").select(
        F.col("id").alias("node_id"), (F.col("created_at") + 5_184_000).alias("at")
    )


MUTATION_SQL = "mu as (select id as node_id, created_at + 5184000 as at from node where superseded_by is not null)"
