"""Retrieval, graph, consolidation and replication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import consolidate as C
from stratalog.operators import graph as G
from stratalog.operators import predicates as P
from stratalog.operators import replication as Y
from stratalog.operators import search as S
from stratalog.plans.bindings import EDGE_SQL, EVENT_SQL, NOW, edges, nodes, recall_event
from stratalog.plans.registry import query
from stratalog.plans.report_queries import _EFF, _HALF
from stratalog.tables import load

QUERY = "the default retention of the shared index moved"
IDENT = "Vec::new wait_branch record_layer stall_mask emit_relay expandEnvelope"
MODEL, DIM = "trellis-64", 64
_TEXT = ["id", "title", "body", "path", "tags_text"]


def _bm25_sql(terms: list[str], filt: str = "true") -> str:
    tok = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_.\-]+')"
    tf = ", ".join(
        " + ".join(f"{w} * len(list_filter(t_{c}, lambda x: x = '{t}'))" for c, w in S.WEIGHTS.items()) + f" as tf{i}" for i, t in enumerate(terms)
    )
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    return f"""tk as (select id, {', '.join(f'{tok.format(c)} as t_{c}' for c in S.WEIGHTS)} from node where {filt}),
      base as (select id, {' + '.join(f'len(t_{c})' for c in S.WEIGHTS)} as dl, {tf} from tk),
      st as (select count(*) as n, avg(dl) as avgdl, {', '.join(f'count(*) filter (tf{i} > 0) as df{i}' for i in range(len(terms)))} from base),
      bm as (select id, round({score}, 6) as score from base, st where {' or '.join(f'tf{i} > 0' for i in range(len(terms)))})"""


_TERMS = S.query_terms(QUERY)


@query(f"with {_bm25_sql(_TERMS)} select id, score from bm order by score desc, id limit 100")
def r2_bm25(spark, sf):
    return S.leg(S.bm25(nodes(spark, sf, *_TEXT), QUERY)).select("id", "score")


@query(f"with {_bm25_sql(_TERMS)} select count(*) as hits, round(max(score), 5) as best, round(avg(score), 5) as mean from bm")
def r2_bm25_all(spark, sf):
    return S.bm25(nodes(spark, sf, *_TEXT), QUERY).agg(F.count("*").alias("hits"), F.round(F.max("score"), 5).alias("best"), F.round(F.avg("score"), 5).alias("mean"))


@query()
def r2_bm25_stemmed(spark, sf):
    return S.leg(S.bm25(nodes(spark, sf, *_TEXT), QUERY, stemmed=True)).select("id", "score", "rank")


_RUNS = "array_to_string(regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+'), ' ')"
_IDENT_SQL = " + ".join(
    f"case when contains(' ' || {_RUNS.format('title')} || '  ' || {_RUNS.format('body')} || ' ', ' {p} ') then 1 else 0 end" for p in S.identifier_phrases(IDENT)
)


@query(f"select id, ({_IDENT_SQL})::double as score from node where ({_IDENT_SQL}) > 0")
def r3_identifier_leg(spark, sf):
    return S.identifier_leg(nodes(spark, sf, "id", "title", "body"), IDENT)


_GOOD = f"select distinct node_id, vec from embedding where model = '{MODEL}' and vec is not null and len(vec) = {DIM} and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0"
_COS = "list_dot_product({0}::double[], {1}::double[]) / sqrt(list_dot_product({0}::double[], {0}::double[])) / sqrt(list_dot_product({1}::double[], {1}::double[]))"


def vectors(spark, sf):
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return load(spark, sf, "embedding").filter((F.col("model") == MODEL) & (F.size("vec") == DIM) & good).select("node_id", "vec").distinct()


def query_vector(spark, sf) -> list[float]:
    return list(vectors(spark, sf).orderBy("node_id").first()["vec"])


@query(f"with g as ({_GOOD}), q as (select vec as qv from g order by node_id limit 1) select node_id as id, round({_COS.format('vec', 'qv')}, 6) as score from g, q order by score desc, id limit 100")
def r4_vector_leg(spark, sf):
    return S.leg(S.vector_leg(vectors(spark, sf), query_vector(spark, sf))).select("id", "score")


@query(f"with g as ({_GOOD}) select node_id, round(list_sum(list_transform(vec, lambda x: abs(x::double))) / sqrt(list_dot_product(vec::double[], vec::double[])), 5) as norm1 from g")
def r21_unit(spark, sf):
    """Sum of the absolute numbers of each vector brought to length 1."""
    u = S.unit("vec")
    return vectors(spark, sf).select("node_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("norm1"))


_FUSED = f"""{_bm25_sql(_TERMS)}, g as ({_GOOD}), q as (select vec as qv from g order by node_id limit 1),
  l1 as (select id, row_number() over (order by score desc, id) - 1 as rank from bm order by score desc, id limit 100),
  l2 as (select id, row_number() over (order by score desc, id) - 1 as rank from (select node_id as id, round({_COS.format('vec', 'qv')}, 6) as score from g, q) order by score desc, id limit 100),
  fu as (select id, sum(1.0 / (60 + rank + 1)) as rrf from (select * from l1 union all select * from l2) group by 1)"""


def fused(spark, sf):
    a = S.leg(S.bm25(nodes(spark, sf, *_TEXT), QUERY))
    return S.rrf(a, S.leg(S.vector_leg(vectors(spark, sf), query_vector(spark, sf))))


@query(f"with {_FUSED} select id, round(rrf, 8) as rrf from fu")
def r5_rrf(spark, sf):
    return fused(spark, sf).select("id", F.round("rrf", 8).alias("rrf"))


_REC = f"case when ({_HALF}) is null then 1.0 else 1.0 / (1.0 + 0.012 * ln(1.0 + greatest({NOW} - created_at, 0) / 86400.0)) end"
_META = "case when json_valid(meta) then json_extract_string(meta, '$.expires_at') end"
_SCORED = f"""{_FUSED}, sc as (select id, title, body, round(rrf * (1 + 0.15 * ln(1 + {_EFF})) * ({_REC}) * (1 + 0.12 * (case when subkind in ('gotcha', 'decision') then 0.25 else 0.0 end))
    * (case when kind in ('symbol', 'codechunk') then 0.85 else 1.0 end), 8) as score
  from fu join node using (id) where deleted_at is null and superseded_by is null and not coalesce(try_cast({_META} as bigint) <= {NOW}, false)),
  pg as (select id, score from (select *, row_number() over (partition by title, body order by score desc, id) as r from sc) where r = 1 order by score desc, id limit 8)"""


@query(f"with {_SCORED} select id, score from sc")
def r6_scored(spark, sf):
    return S.score(fused(spark, sf), load(spark, sf, "node"), NOW).select("id", "score")


@query(f"with {_SCORED} select id, score from pg")
def r27_recall(spark, sf):
    """The flagship: a page of hybrid recall."""
    return S.page(S.score(fused(spark, sf), load(spark, sf, "node"), NOW)).select("id", "score")


@query()
def r27_recall_all_legs(spark, sf):
    """A page from all legs: words by their stems and without accents, identifier phrases, vectors."""
    n, text = nodes(spark, sf, *_TEXT), f"{QUERY} {IDENT}"
    legs = [S.bm25(n, text, stemmed=True), S.identifier_leg(n, text), S.vector_leg(vectors(spark, sf), query_vector(spark, sf))]
    return S.page(S.score(S.rrf(*map(S.leg, legs)), load(spark, sf, "node"), NOW)).select("id", "score")


@query(f"""with {EVENT_SQL}, i as (select node_id, count(*) filter (event = 'shown') as shown, count(*) filter (event = 'opened') as opened, max(case when event = 'shown' then at end) as last_shown from ev group by 1)
  select node_id, round(case when shown >= 10 and opened = 0 then greatest(0.7, 1.0 - 0.5 * power(2, -greatest(1706745600 - last_shown, 0) / 86400.0 / 30)) else 1.0 end, 6) as damp from i""")
def r12_impression_damp(spark, sf):
    from stratalog.plans.report_queries import a2_impressions

    return a2_impressions(spark, sf).select("node_id", F.round(S.impression_damp(1_706_745_600, 0.5), 6).alias("damp"))


_TRIG = ("retention", "shared index")


@query("select id, " + " or ".join(f"contains(lower(coalesce(body, '')), '{p}')" for p in _TRIG) + " as fires from node where kind = 'memory' and deleted_at is null and subkind = 'gotcha'")
def r16_triggers(spark, sf):
    """Memories whose text holds one of the trigger phrases."""
    n = nodes(spark, sf, "id", "kind", "subkind", "deleted_at", "body").filter("kind = 'memory' and deleted_at is null and subkind = 'gotcha'")
    phrases = F.array(*[F.lit(p) for p in _TRIG])
    return n.select("id", F.exists(phrases, lambda p: F.contains(F.lower(F.coalesce("body", F.lit(""))), p)).alias("fires"))


_BRIEF = f"""with b as (select id, round((case when pinned then 2.0 else 1.0 end) * (1 + 0.15 * ln(1 + {_EFF})) * ({_REC}) * 1.03 * (case when project_id = 7 then 1.5 else 1.0 end), 6) as score, updated_at, ceil(length(coalesce(title, '')) / 4.0)::bigint as tokens
  from node where kind = 'memory' and deleted_at is null and superseded_by is null and subkind in ('gotcha', 'decision') and (project_id is null or project_id = 7)), f as (select max(score) * 0.75 as low from b)"""


def brief(spark, sf):
    """Candidates of a session brief above three quarters of the best score."""
    n = nodes(spark, sf, "id", "kind", "subkind", "title", "project_id", "pinned", "strength", "created_at", "updated_at", "last_accessed", "deleted_at", "superseded_by")
    n = n.filter(P.briefable() & P.scope(7))
    from stratalog.operators.ledger import effective_strength

    s = F.when(F.col("pinned"), 2.0).otherwise(1.0) * (1 + 0.15 * F.ln(1 + effective_strength(NOW))) * S.recency(NOW) * 1.03 * F.when(F.col("project_id") == 7, 1.5).otherwise(1.0)
    b = n.select("id", F.round(s, 6).alias("score"), "updated_at", X.estimate_tokens("title").alias("tokens"))
    low = b.agg((F.max("score") * 0.75).alias("low"))
    return b.crossJoin(F.broadcast(low)).filter("score >= low").drop("low")


@query(_BRIEF + " select id, score from b, f where score >= low")
def r24_brief(spark, sf):
    return brief(spark, sf).select("id", "score")


@query()
def t10_brief_filled(spark, sf):
    """What fits into the brief's budget of 150 tokens, in order."""
    got = S.fill_budget(brief(spark, sf), 150)
    return spark.createDataFrame([(i, k) for k, i in enumerate(got)], "id long, place int")


def calls(spark, sf):
    return edges(spark, sf).filter("rel = 'calls'").select("src", "dst").distinct()


@query(f"with {EDGE_SQL} select dst, count(*) as degree from (select distinct src, dst from ed where rel = 'calls') group by 1 order by 2 desc, 1 limit 10")
def g5_hubs(spark, sf):
    return G.hubs(calls(spark, sf))


_HUB = f"{EDGE_SQL}, c as (select distinct src, dst from ed where rel = 'calls'), hub as (select dst as id from c group by 1 order by count(*) desc, 1 limit 1)"


@query(f"""with recursive {_HUB}, w as (select id, 0 as d from hub union select c.src, w.d + 1 from w join c on c.dst = w.id where w.d < 3)
  select id, min(d)::int as distance from w group by 1 having min(d) > 0""")
def g2_callers(spark, sf):
    hub = G.hubs(calls(spark, sf), 1).select(F.col("dst").alias("id"))
    return G.reach(calls(spark, sf), hub, 3, backwards=True)


@query(f"""with recursive {EDGE_SQL}, c as (select distinct src, dst from ed where rel in ('calls', 'imports')), seed as (select dst as id from c group by 1 order by count(*) desc, 1 limit 3),
  w as (select id, 0 as d from seed union select c.src, w.d + 1 from w join c on c.dst = w.id where w.d < 3) select id, min(d)::int as distance from w group by 1 having min(d) > 0""")
def g3_impact(spark, sf):
    e = edges(spark, sf).filter("rel in ('calls', 'imports')").select("src", "dst").distinct()
    return G.reach(e, G.hubs(e, 3).select(F.col("dst").alias("id")), 3, backwards=True)


@query(f"""with recursive {EDGE_SQL}, c as (select distinct src, dst from ed where rel = 'calls'), hub as (select dst as id from c group by 1 order by count(*) desc, 1 limit 1),
  back as (select id, 0 as d from hub union select c.src, b.d + 1 from back b join c on c.dst = b.id where b.d < 2),
  far as (select id from (select id, min(d) as d from back group by 1) where d > 0 order by d desc, id limit 1),
  walk as (select id, 0 as d from far union select c.dst, w.d + 1 from walk w join c on c.src = w.id where w.d < 12), near as (select id, min(d) as d from walk group by 1),
  path as (select id, d from near where id = (select id from hub) union all select (select min(c.src) from c join near n on n.id = c.src where c.dst = p.id and n.d = p.d - 1), p.d - 1 from path p where p.d > 0)
  select d::int as step, id from path""")
def g4_shortest_path(spark, sf):
    """From the smallest caller two calls away to the most called symbol."""
    hub = G.hubs(calls(spark, sf), 1).first()["dst"]
    far = G.reach(calls(spark, sf), spark.createDataFrame([(hub,)], "id long"), 2, backwards=True).orderBy(F.desc("distance"), "id").first()
    path = G.shortest_path(calls(spark, sf), far["id"], hub) if far else []
    return spark.createDataFrame([(i, v) for i, v in enumerate(path or [])], "step int, id long")


@query()
def g6_communities(spark, sf):
    return G.communities(calls(spark, sf))


@query(f"""with {EDGE_SQL} select id, src, dst, rel, weight from (select *, row_number() over (partition by src, dst, rel order by created_at desc, id desc) as r from ed) where r = 1""")
def g14_edge_upsert(spark, sf):
    e = edges(spark, sf).drop("meta")
    return G.upsert_edges(e, e.limit(0)).select("id", "src", "dst", "rel", "weight")


@query(f"with {EDGE_SQL} select src as node, rel, count(*) as n from ed where rel in ('links', 'mentions', 'tagged', 'describes', 'about', 'relates', 'supersedes', 'summarizes', 'derived_from', 'calls', 'imports', 'defines', 'member_of', 'co_recalled') group by 1, 2")
def g17_edges_of_node(spark, sf):
    rels = "links mentions tagged describes about relates supersedes summarizes derived_from calls imports defines member_of co_recalled".split()
    return edges(spark, sf).filter(F.col("rel").isin(*rels)).groupBy(F.col("src").alias("node"), "rel").agg(F.count("*").alias("n"))


_CALLS = "select src as caller, n.title as callee, n.parent_id as file_id from ed join node n on n.id = ed.dst and n.kind = 'symbol' where rel = 'calls'"


@query(f"""with {EDGE_SQL}, s as (select distinct node_id as id, name, file_id from symbol_def where kind in ('function', 'method')), c as (select distinct caller, callee, file_id from ({_CALLS}) where callee is not null),
  j as (select c.caller, c.callee, s.id as target, case when s.file_id = c.file_id then 1 else 3 end as tier from c join s on s.name = c.callee), b as (select *, min(tier) over (partition by caller, callee) as best from j),
  k as (select *, count(*) over (partition by caller, callee) as n from b where tier = best)
  select caller, callee, target, tier::int as tier, round(case when tier < 3 then 1.0 / n when n = 1 then 0.8 else 1.0 / n end, 6) as weight from k where n <= 3 or tier < 3""")
def g8_call_resolution(spark, sf):
    n = nodes(spark, sf, "id", "kind", "title", "parent_id").filter("kind = 'symbol'").select(F.col("id").alias("dst"), F.col("title").alias("callee"), F.col("parent_id").alias("file_id"))
    c = edges(spark, sf).filter("rel = 'calls'").join(n, "dst").filter("callee is not null").select(F.col("src").alias("caller"), "callee", "file_id").distinct()
    s = load(spark, sf, "symbol_def").filter("kind in ('function', 'method')").select(F.col("node_id").alias("id"), "name", "file_id", F.lit(None).cast("string").alias("qualified")).distinct()
    return G.resolve_calls(c.withColumn("receiver", F.lit(None).cast("string")), s)


@query("""with n as (select json_extract_string(meta, '$.stable_id') as stable_id, id from node where kind = 'symbol' and json_valid(meta))
  select stable_id, min(id) as id, count(*) as n from n where stable_id is not null group by 1""")
def g11_stable_ids(spark, sf):
    n = nodes(spark, sf, "id", "kind", "meta").filter("kind = 'symbol'").select(P.meta("stable_id").alias("stable_id"), "id").filter("stable_id is not null")
    return n.groupBy("stable_id").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query(r"""with m as (select id, unnest(list_distinct(regexp_extract_all(lower(coalesce(body, '')), '[\p{L}\p{N}_]+'))) as w from node where kind = 'memory' and deleted_at is null),
  s as (select lower(name) as w, min(node_id) as symbol, count(distinct node_id) as n from symbol_def where length(name) >= 4 and contains(name, '_') group by 1)
  select m.id, s.symbol from m join s using (w) where n <= 3""")
def g13_link_scan(spark, sf):
    """Memories that name a symbol few carry: words of the text meet names by an equi join."""
    m = nodes(spark, sf, "id", "kind", "deleted_at", "body").filter("kind = 'memory' and deleted_at is null")
    m = m.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("body", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w"))
    s = load(spark, sf, "symbol_def").filter("length(name) >= 4 and contains(name, '_')").groupBy(F.lower("name").alias("w")).agg(F.min("node_id").alias("symbol"), F.countDistinct("node_id").alias("n"))
    return m.join(s.filter("n <= 3"), "w").select("id", "symbol")


def planted_memories(spark, sf):
    """Live memories with their vectors, and four later copies of each with ever more of the vector blotted out, every
    other one denying: the tables have no memories as close as that."""
    n = nodes(spark, sf, "id", "kind", "subkind", "project_id", "created_at", "pinned", "body", "deleted_at", "superseded_by")
    m = C.memory_vectors(n, vectors(spark, sf)).select("id", "subkind", "project_id", "created_at", "pinned", "body", "vec").distinct()
    out = m
    for j in range(1, 5):
        blot = F.concat(F.array_repeat(F.lit(0.0).cast("float"), 4 * j), F.slice("vec", 4 * j + 1, DIM))
        denies = F.concat(F.coalesce("body", F.lit("")), F.lit(" not" if j % 2 else ""))
        out = out.unionByName(m.select((F.col("id") + j * 1_000_000_000).alias("id"), "subkind", "project_id", (F.col("created_at") + j).alias("created_at"), F.lit(False).alias("pinned"), denies.alias("body"), blot.alias("vec")))
    return out


def memory_pairs(spark, sf, *bucket):
    return C.similar_pairs(planted_memories(spark, sf).select("id", *bucket, "vec"), *bucket)


_LIVE = f"live as (select distinct n.id, n.subkind, n.project_id, n.created_at, n.pinned, n.body, g.vec from node n join ({_GOOD}) g on g.node_id = n.id where n.kind = 'memory' and n.deleted_at is null and n.superseded_by is null)"
_COPIES = " ".join(
    f"union all select id + {j}000000000, subkind, project_id, created_at + {j}, false, coalesce(body, '') || '{' not' if j % 2 else ''}', list_concat(list_transform(range({4 * j}), lambda x: 0.0::float), vec[{4 * j + 1}:]) from live" for j in range(1, 5)
)
_MV = f"{_LIVE}, mv as (select * from live {_COPIES})"
_PAIRS = f"{_MV}, pr as (select a.project_id, a.subkind as sa, b.subkind as sb, a.id as a, b.id as b, round({_COS.format('a.vec', 'b.vec')}, 6) as sim from mv a join mv b on a.id < b.id and a.project_id is not distinct from b.project_id)"


@query(f"with {_PAIRS} select a, b, sim from pr where sim >= 0.8")
def j14_similar_memories(spark, sf):
    return memory_pairs(spark, sf, "project_id").select("a", "b", "sim")


@query(f"with {_PAIRS} select a, b, sim from pr where sim >= 0.92 and sa is not distinct from sb")
def j13_similar_of_a_kind(spark, sf):
    return memory_pairs(spark, sf, "subkind", "project_id").filter("sim >= 0.92").select("a", "b", "sim")


@query(f"""with {_PAIRS}, d as (select case when x.created_at < y.created_at or (x.created_at = y.created_at and x.id < y.id) then x.id else y.id end as older,
    case when x.created_at < y.created_at or (x.created_at = y.created_at and x.id < y.id) then y.id else x.id end as newer from pr join mv x on x.id = a join mv y on y.id = b where sim >= 0.92 and sa is not distinct from sb)
  select older, min(newer) as newer from d join mv on mv.id = older where not coalesce(pinned, false) group by 1""")
def k1_duplicates(spark, sf):
    """Within a kind and project the older of two near copies gives way."""
    return C.duplicates(memory_pairs(spark, sf, "subkind", "project_id"), planted_memories(spark, sf))


_NEG = " or ".join(f"contains(lower(coalesce({{0}}.body, '')), '{n.replace(chr(39), chr(39) * 2)}')" for n in X.NEGATIONS)


@query(f"with {_PAIRS} select a, b, sim from pr join mv x on x.id = a join mv y on y.id = b where sim >= 0.85 and sim < 0.92 and sa is not distinct from sb and ({_NEG.format('x')}) <> ({_NEG.format('y')})")
def k2_contradictions(spark, sf):
    return C.contradictions(memory_pairs(spark, sf, "subkind", "project_id"), planted_memories(spark, sf))


@query(f"""with recursive {_PAIRS}, e as (select a, b from pr where sim >= 0.8 union select b, a from pr where sim >= 0.8), r as (select a as id, a as c from e union select e.b, r.c from r join e on e.a = r.id),
  k as (select id, min(c) as component from r group by 1) select id, component, count(*) over (partition by component) as size from k qualify count(*) over (partition by component) >= 5""")
def k3_clusters(spark, sf):
    return C.clusters(memory_pairs(spark, sf, "project_id"))


@query(f"""select id from node where kind = 'memory' and deleted_at is null and superseded_by is null and not coalesce(pinned, false) and coalesce(last_accessed, created_at) < {NOW} - 90 * 86400 and {_EFF} < 0.05""")
def k4_decayed(spark, sf):
    return C.decayed(nodes(spark, sf, "id", "kind", "subkind", "strength", "pinned", "last_accessed", "created_at", "deleted_at", "superseded_by"), NOW)


_R = "id, uid, updated_at, deleted_at, strength, access_count"


@query(f"select id, greatest(updated_at, coalesce(deleted_at, 0)) as activity from node where kind = 'memory' and greatest(updated_at, coalesce(deleted_at, 0)) > 1740000000")
def y1_changes_since(spark, sf):
    return Y.changes_since(nodes(spark, sf, "id", "kind", "updated_at", "deleted_at").filter("kind = 'memory'"), 1_740_000_000).select("id", Y.activity().alias("activity"))


@query(f"""with l as (select {_R}, 0 as incoming from node where kind = 'memory' and (project_id is null or project_id <> 7)),
  r as (select id, uid, updated_at + (id % 5 - 2) * 60 as updated_at, case when id % 11 = 0 then updated_at end as deleted_at, 9.0 as strength, 0 as access_count, 1 as incoming from node where kind = 'memory' and project_id is not null),
  w as (select *, row_number() over (partition by uid order by greatest(updated_at, coalesce(deleted_at, 0)) desc, deleted_at is not null desc, incoming, id) as k from (select * from l union all select * from r))
  select w.uid, w.updated_at, w.deleted_at, w.incoming::int as incoming, round(coalesce(l.strength, w.strength), 6) as strength from w left join l using (uid) where k = 1""")
def y2_apply_lww(spark, sf):
    m = nodes(spark, sf, "id", "uid", "kind", "project_id", "updated_at", "deleted_at", "strength", "access_count").filter("kind = 'memory'").drop("kind")
    local = m.filter("project_id is null or project_id <> 7").drop("project_id")
    other = m.filter("project_id is not null").select(
        "id", "uid", (F.col("updated_at") + (F.col("id") % 5 - 2) * 60).alias("updated_at"), F.when(F.col("id") % 11 == 0, F.col("updated_at")).alias("deleted_at"),
        F.lit(9.0).alias("strength"), F.lit(0).cast("long").alias("access_count"),
    )
    return Y.apply_lww(local, other).select("uid", "updated_at", "deleted_at", "incoming", F.round("strength", 6).alias("strength"))


@query("""with h as (select id, kind, content_hash, row_number() over (partition by content_hash order by created_at, id) as r, count(*) over (partition by content_hash) as n from node where kind = 'memory' and deleted_at is null and content_hash is not null)
  select id, case when r = 1 then 'stored' else 'duplicate' end as status from h""")
def m2_exact_duplicates(spark, sf):
    n = nodes(spark, sf, "id", "kind", "content_hash", "created_at", "deleted_at").filter("kind = 'memory' and deleted_at is null and content_hash is not null")
    w = Window.partitionBy("content_hash").orderBy("created_at", "id")
    return n.withColumn("r", F.row_number().over(w)).select("id", F.when(F.col("r") == 1, "stored").otherwise("duplicate").alias("status"))


@query(f"""with {EDGE_SQL} select count(*) as refused from ed where rel in ('supersedes', 'co_recalled')""")
def m19_authoring_guard(spark, sf):
    return edges(spark, sf).filter("rel in ('supersedes', 'co_recalled')").agg(F.count("*").alias("refused"))


@query("""select project_id, max_by(id, updated_at * 1000000 + id) as rules_id from node where kind = 'memory' and deleted_at is null and subkind = 'decision' and project_id is not null group by 1""")
def m18_rules_pack(spark, sf):
    """The newest live decision of each project stands for its rules."""
    n = nodes(spark, sf, "id", "kind", "subkind", "project_id", "updated_at", "deleted_at").filter("kind = 'memory' and deleted_at is null and subkind = 'decision' and project_id is not null")
    return n.groupBy("project_id").agg(F.max_by("id", F.col("updated_at") * 1_000_000 + F.col("id")).alias("rules_id"))


@query(f"""with {EVENT_SQL} select distinct query_hash, first_value(node_id) over (partition by query_hash order by at, id) as first_node from ev where event = 'shown'""")
def e12_first_shown(spark, sf):
    w = Window.partitionBy("query_hash").orderBy("at", "id")
    return recall_event(spark, sf).filter("event = 'shown'").withColumn("r", F.row_number().over(w)).filter("r = 1").select("query_hash", F.col("node_id").alias("first_node"))
