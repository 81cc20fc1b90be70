"""Parent-child links of unknown depth turned into roots, depths, paths and descendants.

Tree contraction. A round rakes every leaf and then compresses chains: a vertex
with one child left is spliced out when it drew a smaller lot than its child and
its parent, so no two neighbours go at once and the child takes over its link. Every removal is written down with the link it had. Trees vanish in a
number of rounds that grows with the logarithm of their size, however deep they
are. Reading the removals backwards gives each vertex its root and depth from
the vertex it hung on. What does not vanish is a loop: compression shrinks it to
a vertex linked to itself, and all that hang on it end there, too.

A round is a grouped count and joins by unique keys. The only join by a hot key
(many children of one parent) has one row per key on its other side, which the
adaptive skew join splits. Each round's remainder and removals are tables in the
shared scratch folder.

Defined cases: a null link gives no row; a link to an absent id ends the walk
where it is; a vertex linked to itself is a loop; of repeated ids the least link
counts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import Scratch
from stratalog.tables import load

KEY, UP = ["s", "id"], ["ps", "pid"]


def _lot(i: int, *cols) -> F.Column:
    """A vertex's lot of a round."""
    return F.xxhash64(*cols, F.lit(i))


def contract(spark, links: DataFrame, present: DataFrame, paths: bool = False) -> DataFrame:
    """``links``: s, id, ps, pid (vertex and its link, each a space and an id).
    ``present``: s, id of all existing vertices.

    Returns s, id, root_id, depth and, with ``paths``, path (ids from the root
    to the vertex). Loops give root_id and depth -1 and a null path.
    """
    scratch = Scratch(spark, "hierarchy")
    empty = F.array().cast("array<bigint>")
    links = links.filter("pid is not null").groupBy("s", "id").agg(F.min(F.struct("ps", "pid")).alias("p"))
    links = links.select("s", "id", "p.ps", "p.pid")
    there = present.select(F.col("s").alias("ps"), F.col("id").alias("pid"), F.lit(True).alias("ok")).distinct()
    linked = scratch.keep(links.join(there, UP, "left"), "linked")
    ends = linked.filter("ok is null").select(
        *KEY, F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"), *([F.array("id").alias("path")] if paths else [])
    )
    step = [F.lit(1).cast("long").alias("w")] + ([empty.alias("via")] if paths else [])
    cur = linked.filter("ok").select(*KEY, *UP, *step)
    extra = ["w"] + (["via"] if paths else [])

    loops, removed, i = [], [], 0
    while True:
        kids = cur.groupBy(*UP).agg(F.count("*").alias("n")).select(F.col("ps").alias("s"), F.col("pid").alias("id"), "n")
        marked = scratch.keep(cur.join(kids, KEY, "left"), f"marked_{i}")
        loop = F.expr("s = ps and id = pid")
        loops.append(marked.filter(loop).select(*KEY))
        leaves = marked.filter(F.col("n").isNull() & ~loop).select(*KEY, *UP, *extra)
        inner = marked.filter(F.col("n").isNotNull() & ~loop).select(*KEY, *UP, *extra)
        removed.append(leaves)
        # chains: one inner child left, and a smaller lot than the child's and the parent's
        single = (
            inner.groupBy(*UP)
            .agg(F.count("*").alias("n"), F.min(F.struct("s", "id")).alias("kid"))
            .filter("n = 1")
            .filter(_lot(i, "ps", "pid") < _lot(i, "kid.s", "kid.id"))
            .select(F.col("ps").alias("s"), F.col("pid").alias("id"), "kid")
        )
        cut = scratch.keep(inner.filter(_lot(i, *KEY) < _lot(i, *UP)).join(single, KEY).select(*KEY, *UP, *extra, "kid"), f"cut_{i}")
        over = cut.select(
            F.col("kid.s").alias("s"), F.col("kid.id").alias("id"), F.col("id").alias("mid"),
            F.col("ps").alias("ps2"), F.col("pid").alias("pid2"), F.col("w").alias("w2"),
            *([F.col("via").alias("via2")] if paths else []),
        )
        kept = inner.join(cut.select(*KEY), KEY, "left_anti").join(over, KEY, "left")
        new = [
            F.coalesce("ps2", "ps").alias("ps"),
            F.coalesce("pid2", "pid").alias("pid"),
            (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"),
        ]
        if paths:
            joined = F.concat("via2", F.array("mid"), "via")
            new.append(F.when(F.col("mid").isNotNull(), joined).otherwise(F.col("via")).alias("via"))
        removed.append(cut.drop("kid"))
        cur = scratch.keep(kept.select(*KEY, *new), f"rest_{i}")
        i += 1
        if cur.isEmpty():
            break

    minus = F.lit(-1).cast("long")
    done = None
    for part in loops:
        rows = part.select(*KEY, minus.alias("root_id"), minus.alias("depth"), *([F.lit(None).cast("array<bigint>").alias("path")] if paths else []))
        done = rows if done is None else done.unionByName(rows)
    done = scratch.keep(done.unionByName(ends), "done")
    for k in range(len(removed) - 1, -1, -1):
        up = done.select(
            F.col("s").alias("ps"), F.col("id").alias("pid"), F.col("root_id").alias("r"), F.col("depth").alias("d"),
            *([F.col("path").alias("up")] if paths else []),
        )
        j = removed[k].join(up, UP, "left")
        got = [
            F.coalesce("r", "pid").alias("root_id"),
            F.when(F.col("d") == -1, minus).otherwise(F.coalesce("d", F.lit(0)) + F.col("w")).alias("depth"),
        ]
        if paths:
            head = F.when(F.col("r").isNull(), F.array("pid")).otherwise(F.col("up"))
            got.append(F.concat(head, "via", F.array("id")).alias("path"))
        part = scratch.keep(j.select(*KEY, *got), f"back_{k}")
        done = done.unionByName(part)
    return done


def store_links(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The store's three links in one vertex table; the space names the link.

    'parent_id' and 'superseded_by' stay within node; 'project_id' leads from
    the space 'node' into 'project' and stays there.
    """
    node = load(spark, sf_dir, "node")
    project = load(spark, sf_dir, "project").select("id", "project_id")
    one = F.array(
        F.struct(F.lit("parent_id").alias("s"), F.lit("parent_id").alias("ps"), F.col("parent_id").alias("pid")),
        F.struct(F.lit("superseded_by").alias("s"), F.lit("superseded_by").alias("ps"), F.col("superseded_by").alias("pid")),
        F.struct(F.lit("node").alias("s"), F.lit("project").alias("ps"), F.col("project_id").alias("pid")),
    )
    links = node.select("id", F.explode(one).alias("l")).select("l.s", "id", "l.ps", "l.pid")
    links = links.filter("pid is not null").unionByName(
        project.select(F.lit("project").alias("s"), "id", F.lit("project").alias("ps"), F.col("project_id").alias("pid"))
    )
    spaces = F.explode(F.array(F.lit("parent_id"), F.lit("superseded_by")))
    present = node.select(spaces.alias("s"), "id").unionByName(project.select(F.lit("project").alias("s"), "id"))
    return links, present


def _link_name(c) -> F.Column:
    return F.when(c.isin("node", "project"), "project_id").otherwise(c)


def p5_found(spark, sf_dir: str) -> DataFrame:
    done = contract(spark, *store_links(spark, sf_dir))
    return done.select(_link_name(F.col("s")).alias("link"), F.col("id").alias("node_id"), "root_id", "depth").distinct()


def p5_paths(spark, sf_dir: str) -> DataFrame:
    """Each vertex's path from its root; ``of`` tells nodes from projects."""
    done = contract(spark, *store_links(spark, sf_dir), paths=True)
    of = F.when(F.col("s") == "project", "project").otherwise("node")
    return done.select(_link_name(F.col("s")).alias("link"), of.alias("of"), F.col("id").alias("node_id"), "root_id", "depth", "path")


def descendants(paths: DataFrame) -> DataFrame:
    """(link, ancestor, descendant, distance) for every pair along a path; loops have none."""
    at = F.posexplode(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))))
    rows = paths.filter("path is not null and depth > 0").select("link", "of", "node_id", "depth", at)
    return rows.select(
        "link", "of", F.col("col").alias("ancestor"), F.col("node_id").alias("descendant"), (F.col("depth") - F.col("pos")).alias("distance")
    )


def p5_descendants(spark, sf_dir: str) -> DataFrame:
    """Number and greatest distance of the descendants of each ancestor."""
    d = descendants(p5_paths(spark, sf_dir))
    return d.groupBy("link", "of", "ancestor").agg(F.count("*").alias("descendants"), F.max("distance").alias("height"))
