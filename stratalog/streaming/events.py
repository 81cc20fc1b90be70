"""Recall events as a stream: daily counts, daily caps, strength per node.

Event time is ``ts``. Nothing is dropped for being late unless ``late`` is given, a
watermark behind which rows are dropped and the state of days and marks is let go;
without it that state grows with the days and nodes seen. State is keyed by node
and lives in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalog.session import Scratch

STEPS = {"opened": 0.3, "useful": 1.0, "not_useful": -1.0}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of recall events."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    e = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    kind = F.create_map(*[F.lit(x) for x in ("view", "shown", "click", "opened", "purchase", "useful", "error", "not_useful")])
    e = e.filter("event_type <> 'signup'")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") + 1000).alias("node_id"), kind[F.col("event_type")].alias("event"), F.to_utc_timestamp("ts", "UTC").alias("ts"))


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late else events


def daily_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """Tumbling days per kind of event."""
    w = _marked(events, late).groupBy(F.window("ts", "1 day"), "event").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("day"), "event", "n")


def daily_first(events: DataFrame, late: str | None = None) -> DataFrame:
    """One event of a kind per node and day."""
    return _marked(events.withColumn("day", F.date_trunc("day", "ts")), late).dropDuplicates(["node_id", "event", "day"])


def fold(rows: pd.DataFrame, strength: float, seen: set[str]) -> tuple[float, set[str]]:
    """Strength after the events (id, event, ts) in the order of time, and the marks (kind and day) that counted."""
    rows = rows[rows["event"].isin(list(STEPS))].sort_values(["ts", "id"])
    marks = rows["event"] + "@" + rows["ts"].dt.strftime("%Y-%m-%d")
    first = ~marks.duplicated() & ~marks.isin(seen)
    for step in rows["event"][first].map(STEPS):
        strength = min(10.0, max(0.05, strength + step))
    return strength, seen | set(marks[first])


def _folding(late: str | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, marks = state.get if state.exists else (1.0, "")
        value, seen = fold(pd.concat(list(frames)), value, set(filter(None, marks.split(","))))
        if late:
            # no event of a day before the watermark's can come any more
            day = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms").strftime("%Y-%m-%d")
            seen = {m for m in seen if m.split("@")[1] >= day}
        state.update((float(value), ",".join(sorted(seen))))
        yield pd.DataFrame({"node_id": [key[0]], "strength": [round(value, 6)]})

    return run


def strength(events: DataFrame, late: str | None = None) -> DataFrame:
    """Strength of each node after every batch, marks capped to one a day and kind. State never times out: a node keeps its strength."""
    rows = _marked(events, late).groupBy("node_id")
    return rows.applyInPandasWithState(_folding(late), "node_id long, strength double", "strength double, days string", "update", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the rows written."""
    spark = df.sparkSession
    s = Scratch(spark, what)
    out, check = s.path("out"), s.path("checkpoint")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    df.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/batch=*")
