"""Scans, look-ups, predicates and joins of the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import predicates as P
from stratalog.plans.bindings import DAY, EDGE_SQL, MUTATION_SQL, NOW, edges, nodes, supersede_ledger
from stratalog.plans.registry import query
from stratalog.sources.files import CLASSES, classify_path
from stratalog.tables import load

_META = "case when json_valid(meta) then json_extract_string(meta, '$.{}') end"


@query("select n.id, n.kind, n.deleted_at is not null as gone from node n where id in (select dst from edge where rel = 'supersedes')")
def s4_batch_lookup(spark, sf):
    ids = edges(spark, sf).filter("rel = 'supersedes'").select(F.col("dst").alias("id"))
    return nodes(spark, sf, "id", "kind", "deleted_at").join(ids, "id", "left_semi").select("id", "kind", F.col("deleted_at").isNotNull().alias("gone"))


@query("""with t as (select right(uid, 6) as tail, count(*) as n from node where deleted_at is null group by 1)
  select id, case when n = 1 then 'node' else 'ambiguous' end as status from node join t on right(uid, 6) = tail where deleted_at is null""")
def s5_resolve_tail(spark, sf):
    n = nodes(spark, sf, "id", "uid", "deleted_at").filter(P.live()).withColumn("tail", F.substring("uid", -6, 6))
    per = n.groupBy("tail").agg(F.count("*").alias("n"))
    return n.join(per, "tail").select("id", F.when(F.col("n") == 1, "node").otherwise("ambiguous").alias("status"))


@query("select id, path from node where kind = 'file' and deleted_at is null and path like '%.rs'")
def s6_path_suffix(spark, sf):
    return nodes(spark, sf, "id", "path", "kind", "deleted_at").filter((F.col("kind") == "file") & P.live() & F.col("path").endswith(".rs")).select("id", "path")


@query("select class, count(*) as files from (select case " + " ".join(f"when regexp_matches(path, '{p}') then '{n}'" for n, p in CLASSES) + " else 'skipped' end as class from node where kind = 'file' and path is not null) group by 1")
def s8_source_classes(spark, sf):
    return nodes(spark, sf, "path", "kind").filter("kind = 'file' and path is not null").groupBy(classify_path().alias("class")).agg(F.count("*").alias("files"))


_DRIFT_SQL = """with prev as (select distinct node_id as id, signature from symbol_def), cur as (select id, body as signature from node where kind = 'symbol' and deleted_at is null)
  select coalesce(prev.id, cur.id) as id, case when prev.id is null then 'added' when cur.id is null then 'removed'
    when prev.signature is distinct from cur.signature then 'changed' else 'unchanged' end as status from prev full outer join cur on prev.id = cur.id"""


def drift(prev, cur):
    """Status of each id of two snapshots (id, signature)."""
    p, c = prev.select("id", F.col("signature").alias("old"), F.lit(1).alias("p")), cur.select("id", F.col("signature").alias("new"), F.lit(1).alias("c"))
    status = F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("unchanged")
    return p.join(c, "id", "full").select("id", status.alias("status"))


@query(_DRIFT_SQL)
def s9_change_detection(spark, sf):
    prev = load(spark, sf, "symbol_def").select(F.col("node_id").alias("id"), "signature").distinct()
    cur = nodes(spark, sf, "id", "kind", "body", "deleted_at").filter("kind = 'symbol' and deleted_at is null").select("id", F.col("body").alias("signature"))
    return drift(prev, cur)


@query(f"select status, count(*) as symbols from ({_DRIFT_SQL}) group by 1")
def s10_drift_report(spark, sf):
    return s9_change_detection(spark, sf).groupBy("status").agg(F.count("*").alias("symbols"))


@query("select distinct chunk_id, array_to_string(list_slice(string_split(body, chr(10)), 2, 4), chr(10)) as lines from doc_chunk where body is not null")
def s11_line_slice(spark, sf):
    lines = F.array_join(F.slice(F.split("body", "\n", -1), 2, 3), "\n")
    return load(spark, sf, "doc_chunk").filter("body is not null").select("chunk_id", lines.alias("lines")).distinct()


@query(f"""with {EDGE_SQL}, l as (select id from node where deleted_at is null)
  select 'node' as what, id from l union all select 'edge', ed.id from ed where rel <> 'co_recalled' and src in (select id from l) and dst in (select id from l)""")
def s16_export(spark, sf):
    """What an export writes: live nodes, and authored edges whose both ends live."""
    alive = nodes(spark, sf, "id", "deleted_at").filter(P.live()).select("id")
    e = edges(spark, sf).filter("rel <> 'co_recalled'")
    e = e.join(alive.select(F.col("id").alias("src")), "src", "left_semi").join(alive.select(F.col("id").alias("dst")), "dst", "left_semi")
    return alive.select(F.lit("node").alias("what"), "id").unionAll(e.select(F.lit("edge").alias("what"), "id"))


_VEC = "vec is not null and len(vec) = dim and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0"


@query(f"""select model, kind, count(*) as vectors from (select distinct node_id, model, dim, vec from embedding where {_VEC}) e
  join node on node.id = e.node_id where deleted_at is null group by 1, 2""")
def s22_vector_load(spark, sf):
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    e = load(spark, sf, "embedding").filter((F.size("vec") == F.col("dim")) & good).select("node_id", "model", "dim", "vec").distinct()
    n = nodes(spark, sf, "id", "kind", "deleted_at").filter(P.live())
    return e.join(n, F.col("node_id") == F.col("id")).groupBy("model", "kind").agg(F.count("*").alias("vectors"))


@query("""select s.node_id, array_to_string(list_slice(string_split(replace(f.content, chr(13) || chr(10), chr(10)), chr(10)), s.start_line, s.end_line), chr(10)) as body
  from (select distinct node_id, file_id, start_line, end_line from symbol_def where start_line is not null and end_line >= start_line) s
  join (select distinct file_id, content from source_file) f using (file_id)""")
def s23_peek(spark, sf):
    """The lines of each symbol from its file."""
    s = load(spark, sf, "symbol_def").filter("start_line is not null and end_line >= start_line").select("node_id", "file_id", "start_line", "end_line").distinct()
    f = load(spark, sf, "source_file").select("file_id", "content").distinct()
    lines = F.split(F.regexp_replace("content", "\r\n", "\n"), "\n", -1)
    cut = F.slice(lines, F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    return s.join(f, "file_id").select("node_id", F.array_join(cut, "\n").alias("body"))


@query("""select 'nodes' as what, count(*) as n from node union all select 'no_text', count(*) from node where coalesce(trim(title), '') = '' and coalesce(trim(body), '') = ''
  union all select 'no_parent', count(*) from node where parent_id is not null and parent_id not in (select id from node)
  union all select 'no_embedding', count(*) from node where kind = 'memory' and deleted_at is null and id not in (select node_id from embedding where node_id is not null)
  union all select 'broken_meta', count(*) from node where meta is not null and not json_valid(meta)""")
def s24_health(spark, sf):
    n = nodes(spark, sf, "id", "kind", "title", "body", "parent_id", "deleted_at", "meta")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    one = n.agg(
        F.count("*").alias("nodes"), F.count(F.when(blank("title") & blank("body"), 1)).alias("no_text"),
        F.count(F.when(F.col("meta").isNotNull() & F.try_parse_json("meta").isNull(), 1)).alias("broken_meta"),
    )
    wide = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in one.columns])).alias("x")).select("x.*")
    lost = n.filter("parent_id is not null").join(n.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").agg(F.lit("no_parent").alias("what"), F.count("*").alias("n"))
    bare = n.filter("kind = 'memory' and deleted_at is null").join(load(spark, sf, "embedding").select(F.col("node_id").alias("id")), "id", "left_anti")
    return wide.unionAll(lost).unionAll(bare.agg(F.lit("no_embedding").alias("what"), F.count("*").alias("n")))


@query("select kind, coalesce(p.title, 'global') as project, count(*) as n from node left join project p on p.id = node.project_id where node.deleted_at is null group by 1, 2")
def s25_status(spark, sf):
    p = load(spark, sf, "project").select(F.col("id").alias("project_id"), F.col("title").alias("project"))
    n = nodes(spark, sf, "kind", "project_id", "deleted_at").filter(P.live())
    return n.join(p, "project_id", "left").groupBy("kind", F.coalesce("project", F.lit("global")).alias("project")).agg(F.count("*").alias("n"))


@query("select kind, count(*) as n from node where project_id is null or project_id = 7 group by 1")
def p_scope(spark, sf):
    return nodes(spark, sf, "kind", "project_id").filter(P.scope(7)).groupBy("kind").agg(F.count("*").alias("n"))


@query("select id from node where created_at <= 1700000000 and (deleted_at is null or deleted_at > 1700000000)")
def p_live_as_of(spark, sf):
    return nodes(spark, sf, "id", "created_at", "deleted_at").filter(P.live(1_700_000_000)).select("id")


@query(f"""with {MUTATION_SQL}, s as (select node_id, max(at) as at from mu group by 1)
  select id, coalesce(try_cast({_META.format('expires_at')} as bigint) <= 1740000000, false) as expired, superseded_by is not null and coalesce(s.at <= 1740000000, true) as superseded
  from node left join s on s.node_id = node.id where kind = 'memory'""")
def p_retired_as_of(spark, sf):
    at = 1_740_000_000
    s = supersede_ledger(spark, sf).groupBy("node_id").agg(F.max("at").alias("at"))
    n = nodes(spark, sf, "id", "kind", "meta", "superseded_by").filter("kind = 'memory'")
    gone = F.col("superseded_by").isNotNull() & F.coalesce(F.col("at") <= at, F.lit(True))
    return n.join(s, F.col("id") == F.col("node_id"), "left").select("id", P.expired(at).alias("expired"), gone.alias("superseded"))


@query(f"""select coalesce({_META.format('confidence')}, 'none') as confidence, case when {_META.format('valid_from')} is not null or {_META.format('valid_to')} is not null then 'declared' else 'unknown' end as validity,
  count(*) as n from node where kind = 'memory' group by 1, 2""")
def p_valid_time(spark, sf):
    n = nodes(spark, sf, "kind", "meta").filter("kind = 'memory'")
    told = F.when(P.valid_at(NOW).isNotNull(), "declared").otherwise("unknown")
    return n.groupBy(F.coalesce(P.meta("confidence"), F.lit("none")).alias("confidence"), told.alias("validity")).agg(F.count("*").alias("n"))


@query("select id from node where kind in ('file', 'chunk', 'annotation') and created_at >= 1740000000 and deleted_at is null")
def p_kind_since(spark, sf):
    return nodes(spark, sf, "id", "kind", "created_at", "deleted_at").filter(P.kinds("doc") & P.live() & (F.col("created_at") >= 1_740_000_000)).select("id")


@query("select id from node where list_contains(string_split(coalesce(tags_text, ''), ' '), 'ingest')")
def p_tagged(spark, sf):
    return nodes(spark, sf, "id", "tags_text").filter(P.tagged("ingest")).select("id")


@query("select id, title, created_at from node where kind = 'memory' and deleted_at is null and subkind = 'gotcha' and (project_id is null or project_id = 7) order by created_at desc, id limit 50")
def p_memory_list(spark, sf):
    n = nodes(spark, sf, "id", "title", "created_at", "kind", "subkind", "project_id", "deleted_at")
    return n.filter(P.kinds("memory") & P.live() & P.scope(7) & (F.col("subkind") == "gotcha")).orderBy(F.desc("created_at"), "id").limit(50).select("id", "title", "created_at")


@query(f"select id from node where kind = 'memory' and deleted_at is not null and coalesce({_META.format('archived')}, '') = ''")
def p_buried(spark, sf):
    return nodes(spark, sf, "id", "kind", "deleted_at", "meta").filter(P.buried()).select("id")


@query("""with e as (select distinct node_id, model, content_hash from embedding where vec is not null)
  select n.id from node n left join e on e.node_id = n.id and e.model = 'trellis-64' where n.deleted_at is null and n.body is not null
    and n.kind in ('memory', 'chunk', 'codechunk', 'symbol', 'annotation') and (e.node_id is null or e.content_hash is null or e.content_hash is distinct from n.content_hash) group by 1""")
def p_pending_embedding(spark, sf):
    e = load(spark, sf, "embedding").filter("vec is not null and model = 'trellis-64'").select("node_id", F.col("content_hash").alias("h")).distinct()
    n = nodes(spark, sf, "id", "kind", "body", "content_hash", "deleted_at").filter(P.live() & F.col("body").isNotNull() & F.col("kind").isin(*P.EMBEDDABLE))
    j = n.join(e, F.col("id") == F.col("node_id"), "left")
    return j.filter(F.col("node_id").isNull() | F.col("h").isNull() | ~F.col("h").eqNullSafe(F.col("content_hash"))).select("id").distinct()


_SYNCABLE = "(n.project_id is null or (p.portable_key is not null and json_extract_string(p.meta, '$.sync') = '1'))"


@query(f"select n.id from node n left join project p on p.id = n.project_id where n.kind = 'memory' and {_SYNCABLE}")
def p_syncable(spark, sf):
    p = load(spark, sf, "project").select(F.col("id").alias("pid"), "portable_key", F.col("meta").alias("pmeta"))
    n = nodes(spark, sf, "id", "kind", "project_id").filter("kind = 'memory'").join(p, F.col("project_id") == F.col("pid"), "left")
    on = F.col("portable_key").isNotNull() & (P.meta("sync", "pmeta") == "1")
    return n.filter(F.col("project_id").isNull() | on).select("id")


@query("select id, subkind from node where kind = 'memory' and deleted_at is null and superseded_by is null and subkind in ('gotcha', 'decision') and (project_id is null or project_id = 7)")
def p_brief_admission(spark, sf):
    return nodes(spark, sf, "id", "kind", "subkind", "project_id", "deleted_at", "superseded_by").filter(P.briefable() & P.scope(7)).select("id", "subkind")


@query(f"""with {EDGE_SQL}, l as (select id, kind from node where deleted_at is null)
  select rel, a.kind as src_kind, b.kind as dst_kind, count(*) as n from ed join l a on a.id = ed.src join l b on b.id = ed.dst group by 1, 2, 3""")
def j5_live_edges(spark, sf):
    n = nodes(spark, sf, "id", "kind", "deleted_at").filter(P.live())
    e = edges(spark, sf)
    e = e.join(n.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), "src").join(n.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind")), "dst")
    return e.groupBy("rel", "src_kind", "dst_kind").agg(F.count("*").alias("n"))


def either_way(e):
    """Each edge from both its ends: node, other."""
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel", "weight").unionAll(e.select("dst", "src", "rel", "weight"))


@query(f"""with {EDGE_SQL}, b as (select src as node, dst as other, rel from ed union all select dst, src, rel from ed)
  select node, count(*) as degree, count(distinct other) as partners from b join node n on n.id = b.node where n.kind = 'memory' group by 1""")
def j6_either_direction(spark, sf):
    m = nodes(spark, sf, "id", "kind").filter("kind = 'memory'").select(F.col("id").alias("node"))
    return either_way(edges(spark, sf)).join(m, "node", "left_semi").groupBy("node").agg(F.count("*").alias("degree"), F.countDistinct("other").alias("partners"))


@query("select p.id, p.title from project p where exists (select 1 from node n where n.project_id = p.id and n.kind = 'symbol' and n.deleted_at is null)")
def j8_projects_with_symbols(spark, sf):
    s = nodes(spark, sf, "project_id", "kind", "deleted_at").filter("kind = 'symbol' and deleted_at is null").select(F.col("project_id").alias("id"))
    return load(spark, sf, "project").select("id", "title").join(s, "id", "left_semi")


@query(f"with {EDGE_SQL} select count(*) as dropped from ed where rel = 'calls' and src in (select id from node where kind = 'symbol' and deleted_at is not null)")
def j10_calls_of_deleted(spark, sf):
    s = nodes(spark, sf, "id", "kind", "deleted_at").filter("kind = 'symbol' and deleted_at is not null").select(F.col("id").alias("src"))
    return edges(spark, sf).filter("rel = 'calls'").join(s, "src", "left_semi").agg(F.count("*").alias("dropped"))


@query("select id, path from node where kind = 'file' and deleted_at is null and id not in (select file_id from source_file where file_id is not null)")
def j11_vanished_files(spark, sf):
    seen = load(spark, sf, "source_file").select(F.col("file_id").alias("id"))
    return nodes(spark, sf, "id", "path", "kind", "deleted_at").filter("kind = 'file' and deleted_at is null").select("id", "path").join(seen, "id", "left_anti")


@query("""with e as (select distinct node_id, model, content_hash from embedding where content_hash is not null and vec is not null),
  d as (select model, content_hash, min(node_id) as donor, count(distinct node_id) as n from e group by 1, 2)
  select e.model, e.node_id, d.donor from e join d using (model, content_hash) where n > 1 and e.node_id <> d.donor""")
def j12_vector_reuse(spark, sf):
    """Vectors that need no inference, since another node has one of the same text."""
    e = load(spark, sf, "embedding").filter("content_hash is not null and vec is not null").select("node_id", "model", "content_hash").distinct()
    d = e.groupBy("model", "content_hash").agg(F.min("node_id").alias("donor"), F.countDistinct("node_id").alias("n")).filter("n > 1")
    return e.join(d, ["model", "content_hash"]).filter("node_id <> donor").select("model", "node_id", "donor")


@query(f"""with {EDGE_SQL} select other, min(node) as first from (select src as node, dst as other from ed union select dst, src from ed) where node <> other group by 1""")
def u1_neighbours(spark, sf):
    b = either_way(edges(spark, sf)).select("node", "other").distinct()
    return b.filter("node <> other").groupBy("other").agg(F.min("node").alias("first"))


@query("select distinct node_id from symbol_def where node_id not in (select id from node where kind = 'symbol' and deleted_at is null)")
def u3_symbols_no_longer_there(spark, sf):
    cur = nodes(spark, sf, "id", "kind", "deleted_at").filter("kind = 'symbol' and deleted_at is null").select(F.col("id").alias("node_id"))
    return load(spark, sf, "symbol_def").select("node_id").distinct().join(cur, "node_id", "left_anti")


_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_.\-]+')"


@query(f"select id, len({_TOK.format('title')}) as title_tokens, len(list_distinct({_TOK.format('body')})) as body_words from node where kind = 'memory'")
def f1_tokens(spark, sf):
    n = nodes(spark, sf, "id", "kind", "title", "body").filter("kind = 'memory'")
    return n.select("id", F.size(X.tokens("title")).cast("long").alias("title_tokens"), F.size(F.array_distinct(X.tokens("body"))).cast("long").alias("body_words"))


@query(f"""with t as (select id, list_distinct({_TOK.format('title')}) as a, list_distinct({_TOK.format('body')}) as b from node where kind = 'annotation'),
  s as (select id, a, b, len(list_intersect(a, b)) as common from t)
  select id, round(case when len(a) = 0 or len(b) = 0 then 0.0 else common::double / (len(a) + len(b) - common) end, 6) as j from s""")
def f3_jaccard(spark, sf):
    n = nodes(spark, sf, "id", "kind", "title", "body").filter("kind = 'annotation'")
    return n.select("id", F.round(X.jaccard(F.array_distinct(X.tokens("title")), F.array_distinct(X.tokens("body"))), 6).alias("j"))


@query("select id, " + " or ".join(f"contains(lower(coalesce(body, '')), '{n.replace(chr(39), chr(39) * 2)}')" for n in X.NEGATIONS) + " as negated from node where kind = 'memory'")
def f5_negated(spark, sf):
    return nodes(spark, sf, "id", "kind", "body").filter("kind = 'memory'").select("id", X.negated("body").alias("negated"))


@query(f"select id, sha256(array_to_string({_TOK.format('body')}, ' ')) as h from node where kind = 'memory' and body is not null")
def f6_content_hash(spark, sf):
    return nodes(spark, sf, "id", "kind", "body").filter("kind = 'memory' and body is not null").select("id", X.content_hash("body").alias("h"))


@query("""with t as (select id, trim(string_split(ltrim(coalesce(body, ''), ' '), chr(10))[1], ' ') as f from node where kind = 'memory')
  select id, case when length(f) > 80 then substr(f, 1, 80) || '…' else f end as title from t""")
def f7_derive_title(spark, sf):
    return nodes(spark, sf, "id", "kind", "body").filter("kind = 'memory'").select("id", X.derive_title("body").alias("title"))


@query(r"""select name, contains(name, '::') or regexp_matches(name, '[\p{L}\p{N}]_[\p{L}\p{N}]') or regexp_matches(name, '[\p{L}\p{N}_]\.[\p{L}\p{N}_]') or regexp_matches(name, '[\p{Ll}\p{N}]\p{Lu}') as shaped
  from (select distinct name from symbol_def where name is not null)""")
def f9_identifier_shaped(spark, sf):
    return load(spark, sf, "symbol_def").select("name").filter("name is not null").distinct().select("name", X.is_identifier_shaped("name").alias("shaped"))


@query("select feed_id, list_filter(list_transform(tags, lambda x: trim(translate(x, '<>&\"''', ''), ' ')), lambda x: x <> '') as tags from (select distinct feed_id, tags from sync_record where tags is not null)")
def f10_sanitize_tags(spark, sf):
    return load(spark, sf, "sync_record").filter("tags is not null").select("feed_id", "tags").distinct().select("feed_id", X.sanitize_tags("tags").alias("tags"))


@query("""select id, (case kind when 'memory' then 'm' when 'chunk' then 'c' when 'codechunk' then 'c' when 'symbol' then 's' when 'file' then 'f' else 'n' end) || ':' || right(uid, 6) as ref from node""")
def f18_short_uid(spark, sf):
    return nodes(spark, sf, "id", "uid", "kind").select("id", X.short_uid("uid", "kind").alias("ref"))


@query("select kind, sum(ceil(length(coalesce(body, '')) / 4.0))::bigint as tokens from node group by 1")
def f19_token_estimate(spark, sf):
    return nodes(spark, sf, "kind", "body").groupBy("kind").agg(F.sum(X.estimate_tokens("body")).alias("tokens"))


@query("select id, path from node where kind = 'file' and path like 'src/%\\_%.rs' escape '\\'")
def f20_glob(spark, sf):
    return nodes(spark, sf, "id", "kind", "path").filter("kind = 'file'").filter(F.col("path").rlike(X.glob_regex("src/*_*.rs"))).select("id", "path")


@query(r"""select id, regexp_replace(regexp_replace(regexp_replace(lower(trim(portable_key, ' ')), '^[a-z+]+://', ''), '^[^@/]*@', ''), '(?:\.git)?/*$', '') as key from project where portable_key is not null""")
def f21_portable_key(spark, sf):
    return load(spark, sf, "project").filter("portable_key is not null").select("id", X.portable_key("portable_key").alias("key"))


@query("select id, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d') as day from node where created_at is not null")
def f14_civil_date(spark, sf):
    return nodes(spark, sf, "id", "created_at").filter("created_at is not null").select("id", F.date_format(X.civil_date("created_at"), "yyyy-MM-dd").alias("day"))


# Invented secrets of every kind, put behind the texts of some documents, which have none of their own.
_PLANTED = {"0": "-----BEGIN RSA PRIVATE " + "KEY-----", "1": "AKIA" + "ABCDEFGH12345678", "2": "ghp_" + "a1" * 18, "3": "xoxb-" + "1234567890a", "4": ".".join(["eyJ" + "abcdefgh1", "eyJ" + "abcdefgh2", "abcdefgh3"]), "5": "AKIA" + "TOOSHORT"}


@query(r"""select kind, count(*) as n from (select case """ + " ".join(f"when regexp_matches(t, '{p}') then '{n}'" for n, p in X.SECRETS.items()) + " end as kind from (select text || ' ' || case doc_id % 10 " + " ".join(f"when {k} then '{v}'" for k, v in _PLANTED.items()) + " else '' end as t from documents where text is not null)) where kind is not null group by 1")
def f32_secrets(spark, sf):
    planted = F.coalesce(F.create_map(*[F.lit(x) for kv in _PLANTED.items() for x in kv])[(F.col("doc_id") % 10).cast("string")], F.lit(""))
    d = load(spark, sf, "documents").filter("text is not null").select(X.secret_kind(F.concat("text", F.lit(" "), planted)).alias("kind"))
    return d.filter("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


@query("select doc_id, regexp_replace(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), '^$', '') as t from documents")
def f15_collapse_ws(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.collapse_ws("text").alias("t"))


del DAY
