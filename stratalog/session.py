"""Spark session settings and the shared scratch folder.

``scratch`` is where iterative operators cut lineage: each step is written as
a Parquet table under the folder named by ``spark.checkpoint.dir``, which every
executor of a cluster shares, so a lost executor costs a re-read and never a
recomputation of the whole chain.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "stratalog", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a local one is made in local mode;
    on a cluster that is an error, for executors would write to disks of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"stratalog-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables of one operator run in the shared folder.

    ``keep`` writes a frame and returns it read back, with a fresh lineage and
    real file statistics for the planner. ``drop`` removes tables that no later
    step reads; what the result still reads stays.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)
