"""Queries of upkeep, evaluation, sessions and the remaining joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import mutations as M
from stratalog.operators import predicates as P
from stratalog.operators import search as S
from stratalog.operators import upkeep as U
from stratalog.plans.bindings import DAY, EDGE_SQL, EVENT_SQL, NOW, SAVINGS_SQL, edges, nodes, recall_event, savings_event
from stratalog.plans.registry import query
from stratalog.plans.search_queries import _SCORED, _TEXT, QUERY, _bm25_sql, fused, query_vector, vectors
from stratalog.tables import load

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_.\-]+')"
_TERMS = S.content_terms(QUERY)
_LIST = "[" + ", ".join(f"'{t}'" for t in _TERMS) + "]"


def scored(spark, sf):
    return S.score(fused(spark, sf), load(spark, sf, "node"), NOW)


@query(f"with {_SCORED} select id, score from sc where score >= 0.012")
def p_min_score(spark, sf):
    return scored(spark, sf).filter("score >= 0.012").select("id", "score")


@query(f"""select coalesce(subkind, 'note') as subkind, count(*) filter (superseded_by is null and not gone) as current, count(*) as with_retired from (select *,
    coalesce(try_cast(case when json_valid(meta) then json_extract_string(meta, '$.expires_at') end as bigint) <= {NOW}, false) as gone from node) where kind = 'memory' and deleted_at is null group by 1""")
def p_include_retired(spark, sf):
    """Live memories without and with the retired ones."""
    n = nodes(spark, sf, "kind", "subkind", "deleted_at", "superseded_by", "meta").filter("kind = 'memory' and deleted_at is null")
    return n.groupBy(F.coalesce("subkind", F.lit("note")).alias("subkind")).agg(F.count(F.when(P.visible(NOW), 1)).alias("current"), F.count(F.when(P.visible(NOW, True), 1)).alias("with_retired"))


@query(f"with {EDGE_SQL} select m.id, count(*) as edges, max(e.weight) as strongest from node m join ed e on e.src = m.id or e.dst = m.id where m.kind = 'memory' group by 1 having count(*) >= 2")
def j7_either_end(spark, sf):
    """Memories with two edges or more at either end; an edge to itself counts once."""
    e = edges(spark, sf)
    ends = e.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), "weight").filter("id is not null")
    m = nodes(spark, sf, "id", "kind").filter("kind = 'memory'").select("id")
    return ends.join(m, "id", "left_semi").groupBy("id").agg(F.count("*").alias("edges"), F.max("weight").alias("strongest")).filter("edges >= 2")


@query("""with r as (select distinct name as ref from symbol_def where name is not null union select cast(file_id as varchar) from symbol_def where file_id is not null union select 'no such thing'),
  s as (select name as ref, count(distinct node_id) as n, min(node_id) as by_name from symbol_def where name is not null group by 1)
  select r.ref, coalesce(node.id, case when n = 1 then by_name end) as id, case when node.id is not null then 'id' when n = 1 then 'symbol' when n > 1 then 'ambiguous' else 'none' end as status
  from r left join node on cast(node.id as varchar) = r.ref left join s on s.ref = r.ref""")
def j23_link_targets(spark, sf):
    d = load(spark, sf, "symbol_def").select(F.col("node_id").alias("id"), "name", "file_id").filter("name is not null")
    refs = d.select(F.col("name").alias("ref")).union(load(spark, sf, "symbol_def").select(F.col("file_id").cast("string")).filter("file_id is not null")).union(spark.sql("select 'no such thing'")).distinct()
    return U.link_targets(refs, nodes(spark, sf, "id"), d)


@query(f"with {SAVINGS_SQL}, s as (select source, greatest(sum(tokens_before) - sum(tokens_after), 0)::bigint as saved from sv group by 1) select source, saved, round(saved * 3.0 / 1e6, 4) as dollars from s")
def a9_saved(spark, sf):
    """Tokens saved by source, never below 0, and dollars at three a million."""
    s = savings_event(spark, sf).groupBy("source").agg(F.greatest(F.sum("tokens_before") - F.sum("tokens_after"), F.lit(0)).alias("saved"))
    return s.select("source", "saved", F.round(F.col("saved") * 3.0 / 1e6, 4).alias("dollars"))


@query(f"""with {EDGE_SQL}, c as (select distinct dst as id from ed where rel = 'summarizes' and src in (select id from node where deleted_at is null)),
  m as (select project_id as grp, count(*) as members, count(c.id) as covered from node left join c using (id) where kind = 'memory' and deleted_at is null and project_id is not null group by 1)
  select grp, members, covered, covered * 2 >= members as done from m""")
def a25_summarised(spark, sf):
    n = nodes(spark, sf, "id", "kind", "project_id", "deleted_at").filter("deleted_at is null")
    return U.covered(edges(spark, sf), n.filter("kind = 'memory' and project_id is not null").select("id", F.col("project_id").alias("grp")), n)


_LABEL = f"{EVENT_SQL}, h as (select query_hash, case when score >= 50 then 'strong' else 'weak' end as label, event in ('opened', 'useful') as relevant from ev where query_hash is not null)"


def labelled(spark, sf):
    e = recall_event(spark, sf).filter("query_hash is not null")
    return e.select("query_hash", F.when(F.col("score") >= 50, "strong").otherwise("weak").alias("label"), F.col("event").isin("opened", "useful").alias("relevant"))


@query(f"with {_LABEL} select label, count(*) filter (relevant) as relevant, count(*) as total, round(count(*) filter (relevant) / count(*), 6) as precision from h group by 1")
def a28_calibration(spark, sf):
    """How often a hit of each label is relevant."""
    n = F.count(F.when(F.col("relevant"), 1))
    return labelled(spark, sf).groupBy("label").agg(n.alias("relevant"), F.count("*").alias("total"), F.round(n / F.count("*"), 6).alias("precision"))


@query(f"""with {_LABEL}, p as (select query_hash, bool_or(label = 'strong') as answered, bool_or(relevant) as answerable from h group by 1)
  select count(*) filter (answerable) as answerable, count(*) filter (answerable and not answered) as false_misses, count(*) filter (not answerable) as unanswerable, count(*) filter (not answerable and answered) as false_answers from p""")
def a28_false_answers(spark, sf):
    """Pages reported as a miss though something on them was of use, and the other way round."""
    p = labelled(spark, sf).groupBy("query_hash").agg(F.bool_or(F.col("label") == "strong").alias("answered"), F.bool_or("relevant").alias("answerable"))
    n = lambda c: F.count(F.when(c, 1))
    a, s = F.col("answerable"), F.col("answered")
    return p.agg(n(a).alias("answerable"), n(a & ~s).alias("false_misses"), n(~a).alias("unanswerable"), n(~a & s).alias("false_answers"))


@query(f"with {EVENT_SQL} select node_id, at // 86400 as day, count(*) as hits from ev where query_hash is not null group by 1, 2 having not bool_or(score >= 50)")
def r14_misses(spark, sf):
    """Pages without a strong hit; a page is what a node was met with in a day."""
    e = recall_event(spark, sf).filter("query_hash is not null")
    p = e.groupBy("node_id", F.floor(F.col("at") / DAY).alias("day")).agg(F.count("*").alias("hits"), F.bool_or(F.col("score") >= 50).alias("strong"))
    return p.filter(~F.col("strong")).select("node_id", "day", "hits")


@query(f"""with {EDGE_SQL}, p as (select count(distinct project_id) as projects from node where kind = 'symbol' and deleted_at is null and project_id is not null), l as (select max(created_at) as last from ed where rel = 'mentions')
  select projects, last, ({NOW} - last) // 86400 as days, coalesce(({NOW} - last) // 86400 >= 30, true) and projects > 0 as stale from p, l""")
def a32_link_scan(spark, sf):
    """Projects with symbols, and the days since memories were last linked to them."""
    p = nodes(spark, sf, "kind", "deleted_at", "project_id").filter("kind = 'symbol' and deleted_at is null").agg(F.countDistinct("project_id").alias("projects"))
    last = edges(spark, sf).filter("rel = 'mentions'").agg(F.max("created_at").alias("last"))
    days = F.floor((F.lit(NOW) - F.col("last")) / DAY)
    j = p.crossJoin(F.broadcast(last))  # one row each
    return j.select("projects", "last", days.alias("days"), (F.coalesce(days >= 30, F.lit(True)) & (F.col("projects") > 0)).alias("stale"))


_HAY = _TOK.format("substr(coalesce(title, '') || chr(10) || coalesce(body, ''), 1, 1500)")


@query(f"""with {_SCORED}, top as (select * from sc order by score desc, id limit 15),
  x as (select id, score, case when coalesce(trim(body), '') <> '' then len(list_filter({_LIST}, lambda t: list_contains({_HAY}, t))) / {len(_TERMS)} end as again from top)
  select id, round(again, 6) as again from x order by x.again desc nulls last, score desc, id limit 8""")
def t4_reranked(spark, sf):
    """The page put in the order of a stand-in scorer: the share of the query's words in a hit; hits without a body get none."""
    share = F.size(F.array_intersect(F.array(*[F.lit(t) for t in _TERMS]), X.tokens(U.pair_text()))) / float(len(_TERMS))
    return U.rerank(scored(spark, sf), F.when(F.trim("body") != "", share)).select("id", F.round("again", 6).alias("again"))


@query(f"""with {_SCORED}, a as (select id from l1 where rank < 10), b as (select id from l2 where rank < 10),
  h as (select pg.id, n.kind, lower(n.title) as name, len(list_filter({_LIST}, lambda t: list_contains({_TOK.format("coalesce(title, '') || ' ' || coalesce(body, '') || ' ' || coalesce(tags_text, '')")}, t))) as overlap from pg join node n using (id))
  select id, overlap, case when kind = 'symbol' and list_contains({_LIST}, name) then 'strong' when overlap >= 2 and id in (select id from a) and id in (select id from b) then 'strong' else 'weak' end as strength from h""")
def r13_match_strength(spark, sf):
    """Labels of a page's hits by the agreement of its two legs."""
    words = S.leg(S.bm25(nodes(spark, sf, *_TEXT), QUERY))
    near = S.leg(S.vector_leg(vectors(spark, sf), query_vector(spark, sf)))
    p = S.page(S.score(S.rrf(words, near), load(spark, sf, "node"), NOW))
    return S.match_strength(p, QUERY, words, near).select("id", "overlap", "strength")


_RULE = "n.kind = 'memory' and n.deleted_at is null and n.superseded_by is null and n.subkind in ('gotcha', 'decision')"
PROMPT = "remember the version before retries disagree and through every budget"
_WANTED = "[" + ", ".join(f"'{t}'" for t in S.content_terms(PROMPT)) + "]"
_NEAR = _SCORED.replace(_bm25_sql(S.query_terms(QUERY)), _bm25_sql(S.query_terms(PROMPT))).replace(
    "q as (select vec as qv from g order by node_id limit 1)",
    f"q as (select vec as qv from g join node n on n.id = g.node_id join bm on bm.id = n.id where {_RULE} order by bm.score desc, n.id limit 1)",
)


@query(f"""with {_NEAR}, h as (select sc.id, sc.score, n.subkind, n.pinned, len(list_filter({_WANTED}, lambda t: list_contains({_TOK.format("coalesce(n.title, '') || ' ' || coalesce(n.body, '') || ' ' || coalesce(n.tags_text, '')")}, t))) as overlap from sc join node n using (id))
  select id, overlap, score from h where (subkind in ('gotcha', 'decision') or pinned) and overlap >= 2 and id in (select id from l2 where rank < 10)""")
def r15_injection(spark, sf):
    """What the floor lets through for a prompt; the vector of the rule that its words find first stands for the text's own."""
    from stratalog.operators import inject
    words = S.bm25(nodes(spark, sf, *_TEXT), PROMPT)
    n = load(spark, sf, "node")
    rules = n.filter(P.briefable()).select("id").join(words, "id").join(vectors(spark, sf).withColumnRenamed("node_id", "id"), "id")
    first = rules.orderBy(F.desc("score"), "id").first()
    near = S.leg(S.vector_leg(vectors(spark, sf), list(first["vec"]) if first else query_vector(spark, sf)))
    hits = S.score(S.rrf(S.leg(words), near), n, NOW).join(n.select("id", "subkind", "pinned"), "id")
    return inject.floor(hits, near, PROMPT).select("id", "overlap", "score")


@query("""with f as (select distinct file_id, len(string_split(content, chr(10))) as last from source_file where content is not null), l as (select file_id, unnest(range(1, last + 1)) as no from f),
  c as (select l.* from l where not exists (select 1 from symbol_def s where s.file_id = l.file_id and l.no between s.start_line and s.end_line)),
  i as (select *, no - row_number() over (partition by file_id order by no) as island from c)
  select file_id, min(no) as run_first, max(no) as run_last from i group by file_id, island""")
def u5_uncovered_lines(spark, sf):
    """Runs of lines of a file that no symbol covers."""
    f = load(spark, sf, "source_file").filter("content is not null").select("file_id", F.size(F.split("content", "\n", -1)).alias("last")).distinct()
    s = load(spark, sf, "symbol_def").select("file_id", F.col("start_line").alias("first"), F.col("end_line").alias("end")).distinct()
    return U.uncovered(s, f, "file_id")


@query("""with t as (select id, body, project_id, unnest(list_distinct(string_split(tags_text, ' '))) as tag, created_at from node where kind = 'memory' and deleted_at is null and tags_text <> '' and (project_id is null or project_id = 7))
  select id, coalesce(length(body), 0) as chars from t where tag = 'sync' order by created_at desc, id limit 1""")
def r26_handoff(spark, sf):
    """What a new session of a project is handed under a tag."""
    n = nodes(spark, sf, "id", "kind", "body", "project_id", "tags_text", "created_at", "deleted_at")
    return U.newest_tagged(n, 7, "sync").select("id", F.coalesce(F.length("body"), F.lit(0)).alias("chars"))


_LATE = 1_706_745_600


@query(f"""with {EDGE_SQL}, {EVENT_SQL}, o as (select distinct node_id as id from ev where event = 'opened' and at <= {_LATE} and at > {_LATE} - 60 * 86400),
  b as (select src as node, dst as partner, weight from ed where rel = 'co_recalled' union all select dst, src, weight from ed where rel = 'co_recalled')
  select partner, max(weight) as weight from b where node in (select id from o) and partner not in (select id from o) group by 1""")
def r28_primed(spark, sf):
    """Partners of what was opened in the two months before a time."""
    return U.primed(recall_event(spark, sf), edges(spark, sf), _LATE, 60 * DAY)


@query("""select id, 'm:' || right(uid, 6) || ' [' || coalesce(subkind, 'note') || '] ' || coalesce(title, '') || case when pinned then ' (pinned)' else '' end || case when superseded_by is not null then ' (superseded)' else '' end as line
  from node where kind = 'memory' and deleted_at is null""")
def f17_lines(spark, sf):
    """A memory on one line, with its marks."""
    n = nodes(spark, sf, "id", "uid", "kind", "subkind", "title", "pinned", "superseded_by", "deleted_at").filter("kind = 'memory' and deleted_at is null")
    mark = lambda c, t: F.when(c, F.lit(t)).otherwise(F.lit(""))
    line = F.concat(X.short_uid("uid", "kind"), F.lit(" ["), F.coalesce("subkind", F.lit("note")), F.lit("] "), F.coalesce("title", F.lit("")), mark(F.col("pinned"), " (pinned)"), mark(F.col("superseded_by").isNotNull(), " (superseded)"))
    return n.select("id", line.alias("line"))


_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@query(f"""with r as (select {_NORM.format('body')} as rules from node where kind = 'memory' and subkind = 'decision' and body is not null order by length(body) desc, id limit 1)
  select id from node, r where kind = 'memory' and coalesce(trim({_NORM.format('body')}), '') <> '' and contains(rules, trim(substr({_NORM.format('body')}, 1, 80)))""")
def f23_rules_duplicates(spark, sf):
    """Memories whose beginning stands in the rules, for which the longest decision stands."""
    n = nodes(spark, sf, "id", "kind", "subkind", "body").filter("kind = 'memory' and body is not null")
    rules = n.filter("subkind = 'decision'").orderBy(F.desc(F.length("body")), "id").first()
    return n.filter(U.duplicates_rules("body", rules["body"] if rules else "")).select("id")


@query("""with p as (select doc_id, round(least(n_chars / 8.0 / 100 * 100.0, 100.0))::int as pct from documents where n_chars is not null)
  select doc_id, case when pct >= 80 then 'context about ' || pct || '% full. Clear or compact it on purpose now; save a handoff first.' end as message from p""")
def f35_guard_messages(spark, sf):
    """What sessions as long as the documents would be told, in a window of a hundred tokens."""
    d = load(spark, sf, "documents").filter("n_chars is not null").select("doc_id", X.estimate_pct("n_chars", 8, 100).alias("pct"))
    return d.select("doc_id", U.guard_message("pct", 80, "pause").alias("message"))


@query("""with m as (select d.file_id as grp, n.path, d.qualified as title from (select distinct node_id, file_id, qualified from symbol_def) d left join node n on n.id = d.file_id),
  d as (select grp, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, count(*) as n from m where path is not null group by 1, 2), d1 as (select * from (select *, row_number() over (partition by grp order by n desc, dir) as r from d) where r = 1),
  w as (select grp, t, count(*) as n from (select grp, unnest(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+')) as t from m) where length(t) > 2 group by 1, 2),
  w3 as (select grp, list(t order by r) as ts from (select *, row_number() over (partition by grp order by n desc, t) as r from w) where r <= 3 group by 1)
  select g.grp, case when coalesce(dir, '') = '' then array_to_string(coalesce(ts, []), '-') else dir || ' (' || array_to_string(coalesce(ts, []), ', ') || ')' end as name
  from (select distinct grp from m) g left join d1 using (grp) left join w3 using (grp)""")
def g7_group_names(spark, sf):
    """Names of groups of symbols as communities get them; a file stands for a community here."""
    d = load(spark, sf, "symbol_def").select("node_id", "file_id", "qualified").distinct()
    n = nodes(spark, sf, "id", "path").select(F.col("id").alias("file_id"), "path")
    return U.group_names(d.join(n, "file_id", "left").select(F.col("file_id").alias("grp"), "path", F.col("qualified").alias("title")))


@query(f"with l as (select project_id, max(updated_at) as last from node where kind = 'memory' and project_id is not null group by 1) select project_id, {NOW} - coalesce(last, 0) >= 7 * 86400 as due from l")
def k6_upkeep_due(spark, sf):
    n = nodes(spark, sf, "kind", "project_id", "updated_at").filter("kind = 'memory' and project_id is not null").groupBy("project_id").agg(F.max("updated_at").alias("last"))
    return n.select("project_id", U.due("last", NOW).alias("due"))


@query(f"""with {EVENT_SQL}, o as (select node_id as id, count(*) as n, max(at) as last from ev where event = 'opened' group by 1)
  select id, coalesce(access_count, 0) + coalesce(n, 0) as access_count, greatest(last_accessed, last) as last_accessed from (select id, access_count, last_accessed from node) left join o using (id) where n is not null
  union all select id, access_count, last_accessed from node where id not in (select id from o)""")
def m6_access(spark, sf):
    """The table after all opens were counted."""
    n = nodes(spark, sf, "id", "access_count", "last_accessed", "updated_at")
    new = U.touched(n, recall_event(spark, sf).filter("event = 'opened'").select("node_id", "at"), 2 * NOW)
    return M.latest(n, new).select("id", "access_count", "last_accessed")


@query("""select id, case when kind = 'memory' and subkind = 'gotcha' then true else pinned end as pinned, case when kind = 'memory' and subkind = 'idea' then 7 else project_id end as project_id from node""")
def m6_pinned_and_moved(spark, sf):
    """All gotchas pinned and all ideas put into one project."""
    n = nodes(spark, sf, "id", "kind", "subkind", "pinned", "project_id", "updated_at")
    m = F.col("kind") == "memory"
    return M.latest(n, U.pinned(n, m & (F.col("subkind") == "gotcha"), True, 2 * NOW), U.moved(n, F.col("subkind") == "idea", 7, 2 * NOW)).select("id", "pinned", "project_id")


@query("""with t as (select id, kind, project_id, collection_id, title, 1000000000 + row_number() over (order by id) - 1 as note from node where kind in ('collection', 'file') and title is not null)
  select note as id, project_id, case when kind = 'collection' then id else collection_id end as collection_id, id as describes, 'About ' || title as body from t""")
def m16_annotations(spark, sf):
    """A note on each collection and file, and the edge that ties it."""
    t = nodes(spark, sf, "id", "kind", "project_id", "collection_id", "title").filter("kind in ('collection', 'file') and title is not null")
    note, edge = U.annotate(t.withColumn("text", F.concat(F.lit("About "), "title")), 1_000_000_000, NOW)
    return note.join(edge.select(F.col("src").alias("id"), F.col("dst").alias("describes")), "id").select("id", "project_id", "collection_id", "describes", "body")


@query(f"""with {SAVINGS_SQL}, x as (select source, tokens_before from sv union all select 'tap', n_chars * 2 from documents where n_chars > 0) select source, count(*) as events, sum(tokens_before)::bigint as tokens_before from x group by 1""")
def m20_savings_appended(spark, sf):
    """The ledger with the savings that responses told appended."""
    d = load(spark, sf, "documents").filter("n_chars > 0").select(F.col("doc_id").alias("id"), F.concat(F.lit('{"usage": {"cache_read_input_tokens": '), (F.col("n_chars") * 2).cast("string"), F.lit("}}")).alias("text"))
    tap = U.cache_savings(d).select(F.lit("tap").alias("source"), "tokens_before")
    s = savings_event(spark, sf).select("source", "tokens_before").unionByName(tap)
    return s.groupBy("source").agg(F.count("*").alias("events"), F.sum("tokens_before").alias("tokens_before"))


@query("select doc_id as id, n_chars * 2 as tokens_before, n_chars * 2 // 10 as tokens_after from documents where n_chars > 0")
def e10_usage(spark, sf):
    """Savings of a cache as responses tell them; each response carries twice the length of a document."""
    d = load(spark, sf, "documents").filter("n_chars > 0").select(F.col("doc_id").alias("id"), F.concat(F.lit('{"usage":{"input_tokens":5,"cache_read_input_tokens":'), (F.col("n_chars") * 2).cast("string"), F.lit("}}")).alias("text"))
    return U.cache_savings(d)


@query(f"""with {EVENT_SQL}, s as (select node_id as session, at, id, case event when 'useful' then 'startup' when 'opened' then 'clear' when 'not_useful' then 'compact' else 'resume' end as source, id * 10 as size from ev),
  k as (select *, max(case when source <> 'resume' then id end) over (partition by session order by at, id rows unbounded preceding) as x, row_number() over (partition by session order by at, id) as p from s),
  l as (select *, max(case when source <> 'resume' then p end) over (partition by session order by p rows unbounded preceding) as q from k)
  select l.id, l.session, case when m.source in ('clear', 'compact') then m.size end as marker from l left join l m on m.session = l.session and m.p = l.q""")
def e11_guard_marks(spark, sf):
    """The marker in force after each event of a session."""
    e = recall_event(spark, sf)
    source = F.when(F.col("event") == "useful", "startup").when(F.col("event") == "opened", "clear").when(F.col("event") == "not_useful", "compact").otherwise("resume")
    return U.guard_marks(e.select(F.col("node_id").alias("session"), "at", "id", source.alias("source"), (F.col("id") * 10).alias("size"))).select("id", "session", "marker")
