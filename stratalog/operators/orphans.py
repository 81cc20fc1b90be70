"""References to records that do not exist.

A reference is a (table, row, side, key) whose key should name a record of a
target table. The fixpoint cascade goes down the graph of foreign keys. Level 0
holds the direct orphans: references whose record is missing, deleted or later
than the reference. A record with a missing or deleted reference is orphaned, and
what refers to it is orphaned by inheritance: each further level is a semi-join
of the remaining links with the records found last, until none is added.

Only the last found records (the frontier) are joined in a level, and every level
is a table in the shared scratch folder; there are as many as the longest chain of
inheritance is long. Keys are joined by shuffle; a hub that draws a third of all
references is split by the adaptive skew join, since the target side has one row
per key.

Defined cases: a null key is no reference; exact repeats of rows count once;
an empty target makes every reference missing; an empty source gives no rows; a
loop of references without an orphan stays untouched, one that hangs on an orphan
is visited once; a reference that is late is an orphan but hands nothing on, for
its record exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.changefeed import sync_changes
from stratalog.session import Scratch
from stratalog.tables import clean_uid, load, month_of


def direct_orphans(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """``refs``: tbl, period, ref_id, side, key, since. ``targets``: key (unique), gone, born.

    Returns the columns of ``refs`` and ``state`` for each broken reference:
    'missing' without a target, 'deleted' when it is gone, 'late' when it was
    born after ``since``.
    """
    t = targets.select(F.col("key").alias("__k"), "gone", "born")
    j = refs.join(t, F.col("key") == F.col("__k"), "left")
    state = (
        F.when(F.col("__k").isNull(), "missing")
        .when(F.col("gone"), "deleted")
        .when(F.col("born") > F.col("since"), "late")
    )
    return j.withColumn("state", state).filter(F.col("state").isNotNull()).drop("__k", "gone", "born")


def sides(df: DataFrame, tbl: str, ref_id: str, since, columns: dict) -> DataFrame:
    """Both ends of an edge table as references, exact repeats once."""
    one = F.array(*[F.struct(F.lit(s).alias("side"), c.alias("key")) for s, c in columns.items()])
    return (
        df.select(
            F.lit(tbl).alias("tbl"), month_of(F.col("created_at")).alias("period"), F.col(ref_id).alias("ref_id"),
            since.alias("since"), F.explode(one).alias("r"),
        )
        .select("tbl", "period", "ref_id", "r.side", "r.key", "since")
        .filter(F.col("key").isNotNull())
        .distinct()
    )


def node_targets(nodes: DataFrame) -> DataFrame:
    """One row per node id; of repeated ids any deleted one marks it gone, the first birth counts."""
    return nodes.groupBy(F.col("id").alias("key")).agg(
        F.max(F.col("deleted_at").isNotNull()).alias("gone"), F.min("created_at").alias("born")
    )


def edge_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    refs = sides(edges, "edge", "id", F.col("created_at"), {"src": F.col("src"), "dst": F.col("dst")})
    return direct_orphans(refs, node_targets(nodes))


def sync_orphans(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Uids meet in their one spelling; a uid is gone when its winning change is a tombstone. A blank one names no record."""
    uid = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(clean_uid(c), F.lit("")))
    refs = sides(edges, "sync_edge", "seq", F.col("received_at"), {"src": uid("src_uid"), "dst": uid("dst_uid")})
    won = sync_changes(records.select("uid", "updated_at", "deleted_at", "feed_id")).select(
        F.col("__key").alias("key"), F.col("__dead").alias("gone")
    )
    born = (
        records.select(clean_uid("uid").alias("key"), "received_at")
        .filter("key is not null")
        .groupBy("key")
        .agg(F.min("received_at").alias("born"))
    )
    return direct_orphans(refs, won.join(born, "key"))


#: The foreign keys that lead to ``node`` or ``project``: table, row's id, time of the row, and per side the column and its target.
KEYS = (
    ("edge", "id", "created_at", {"src": ("src", "node"), "dst": ("dst", "node")}),
    ("node", "id", "created_at", {"parent": ("parent_id", "node"), "superseded_by": ("superseded_by", "node"), "project": ("project_id", "project")}),
    ("project", "id", "created_at", {"project": ("project_id", "project")}),
    ("doc_chunk", "chunk_id", None, {"file": ("file_id", "node")}),
    ("symbol_def", "node_id", None, {"node": ("node_id", "node"), "file": ("file_id", "node")}),
    ("embedding", "node_id", None, {"node": ("node_id", "node")}),
)


def key_references(spark, sf_dir: str) -> DataFrame:
    """tbl, period, ref_id, side, space, key, since of every reference to a node or project, exact repeats once."""
    out = None
    for tbl, row, at, links in KEYS:
        one = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(space).alias("space"), F.col(c).alias("key")) for s, (c, space) in links.items()]))
        since = F.col(at) if at else F.lit(None).cast("long")
        part = load(spark, sf_dir, tbl).select(F.lit(tbl).alias("tbl"), month_of(since).alias("period"), F.col(row).alias("ref_id"), since.alias("since"), one.alias("r"))
        part = part.select("tbl", "period", "ref_id", "r.side", "r.space", "r.key", "since").filter("key is not null and ref_id is not null").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def key_targets(spark, sf_dir: str) -> DataFrame:
    """space, key, gone, born of the nodes and projects."""
    node, project = (node_targets(load(spark, sf_dir, t)).withColumn("space", F.lit(t)) for t in ("node", "project"))
    return node.unionByName(project)


def cascade(spark, refs: DataFrame, targets: DataFrame) -> DataFrame:
    """The broken references with how ('direct' or 'inherited') and state.

    ``refs``: tbl, period, ref_id, side, space, key, since; ``targets``: space,
    key, gone, born. A row (tbl, ref_id) is itself the record (space, key) of the
    same name. Inherited references hold themselves; their state is 'orphaned'.
    """
    s = Scratch(spark, "cascade")
    t = targets.select(F.col("space").alias("__s"), F.col("key").alias("__k"), "gone", "born")
    state = (
        F.when(F.col("__k").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("born") > F.col("since"), "late")
    )
    judged = refs.join(t, (F.col("space") == F.col("__s")) & (F.col("key") == F.col("__k")), "left").withColumn("state", state)
    judged = s.keep(judged.select("tbl", "period", "ref_id", "side", "space", "key", "state"), "judged")
    direct = judged.filter("state is not null")
    record = [F.col("tbl").alias("space"), F.col("ref_id").alias("key")]
    links = judged.filter("state is null and tbl in ('node', 'project')")
    found = frontier = s.keep(direct.filter("state <> 'late' and tbl in ('node', 'project')").select(*record).distinct(), "level_0")
    level = 0
    while not frontier.isEmpty():
        level += 1
        hit = links.join(frontier, ["space", "key"], "left_semi").select(*record).distinct().join(found, ["space", "key"], "left_anti")
        frontier = s.keep(hit, f"level_{level}")
        found = found.unionByName(frontier)
    cols = ["tbl", "period", "ref_id", "side"]
    inherited = judged.filter("state is null").join(found, ["space", "key"], "left_semi")
    return direct.select(*cols, "state", F.lit("direct").alias("how")).unionByName(inherited.select(*cols, F.lit("orphaned").alias("state"), F.lit("inherited").alias("how")))


def orphan_references(spark, sf_dir: str) -> DataFrame:
    """Every broken reference of all tables, direct or inherited: tbl, period, ref_id, side, state, how.

    References by uid lead to records that refer to nothing, so they are never inherited.
    """
    s_edges, records = load(spark, sf_dir, "sync_edge"), load(spark, sf_dir, "sync_record")
    by_uid = sync_orphans(s_edges, records).select("tbl", "period", "ref_id", "side", "state", F.lit("direct").alias("how"))
    return cascade(spark, key_references(spark, sf_dir), key_targets(spark, sf_dir)).unionByName(by_uid)


def p2_found(spark, sf_dir: str) -> DataFrame:
    out = orphan_references(spark, sf_dir).filter("how = 'direct' and tbl in ('edge', 'sync_edge')")
    return out.select("tbl", "period", "ref_id", "side", "state").distinct()


def p2_report(spark, sf_dir: str) -> DataFrame:
    """Broken references per table and month (null where rows have no time), direct apart from inherited."""
    return orphan_references(spark, sf_dir).groupBy("tbl", "side", "period", "state", "how").agg(F.count("*").alias("refs"))
