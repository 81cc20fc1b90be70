"""Reading the store's tables: one Parquet data set per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE_TABLES = ("node", "project", "edge", "embedding", "doc_chunk", "symbol_def", "sync_record", "sync_edge")
CORPUS_TABLES = ("documents", "source_file", "mix_target")
STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

NODE_SCHEMA = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("id", T.LongType()), ("uid", T.StringType()), ("kind", T.StringType()), ("subkind", T.StringType()),
            ("project_id", T.LongType()), ("collection_id", T.LongType()), ("parent_id", T.LongType()),
            ("title", T.StringType()), ("body", T.StringType()), ("path", T.StringType()),
            ("span_start", T.LongType()), ("span_end", T.LongType()), ("lang", T.StringType()),
            ("tags_text", T.StringType()), ("content_hash", T.StringType()), ("meta", T.StringType()),
            ("created_at", T.LongType()), ("updated_at", T.LongType()), ("access_count", T.LongType()),
            ("last_accessed", T.LongType()), ("strength", T.DoubleType()), ("pinned", T.BooleanType()),
            ("superseded_by", T.LongType()), ("deleted_at", T.LongType()),
        )
    ]
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; a column that holds no time zone stays without one."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_uid(c) -> F.Column:
    """A uid in its one spelling: upper case, no blanks around it; blank becomes null."""
    u = F.upper(F.regexp_replace(c, r"^[\s\u00a0\u200b\ufeff]+|[\s\u00a0\u200b\ufeff]+$", ""))
    return F.when(u != "", u)


def month_of(seconds) -> F.Column:
    """``yyyy-MM`` in UTC of Unix seconds, whatever the session's time zone."""
    days = F.floor(seconds / F.lit(86400)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")
