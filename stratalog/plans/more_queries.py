"""Mutations, reviews, evaluation, injection and the remaining text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import mutations as M
from stratalog.operators import predicates as P
from stratalog.plans.bindings import DAY, EDGE_SQL, EVENT_SQL, MUTATION_SQL, NOW, edges, nodes, recall_event, supersede_ledger
from stratalog.plans.registry import query
from stratalog.plans.report_queries import _GROUND, _LINES, grounding
from stratalog.plans.source_queries import _TURN, turns
from stratalog.tables import load

_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_.\-]+')"
_CMP = r"list_distinct(list_filter(list_transform(" + _TOK + r", lambda x: regexp_replace(x, '^[._\-]+|[._\-]+$', '', 'g')), lambda x: x <> ''))"


@query(f"select id, len({_CMP.format('body')}) as words from node where kind = 'annotation'")
def f2_comparison_tokens(spark, sf):
    return nodes(spark, sf, "id", "kind", "body").filter("kind = 'annotation'").select("id", F.size(X.comparison_tokens("body")).cast("long").alias("words"))


_DENIES = "(" + " or ".join(f"contains(lower(coalesce({{}}, '')), '{n.replace(chr(39), chr(39) * 2)}')" for n in X.NEGATIONS) + ")"
_REWORD = f"""with p as (select a.id, a.body as x, b.body as y, {_CMP.format('a.body')} as s, {_CMP.format('b.body')} as t from node a join node b on b.id = a.superseded_by),
  q as (select *, len(list_intersect(s, t)) as c, least(len(s), len(t)) as small, greatest(len(s), len(t)) as large from p)
  select id, case when c = len(s) and c = len(t) then true when {_DENIES.replace('{}', 'x')} <> {_DENIES.replace('{}', 'y')} then false
    when c = small and small >= 4 and large - small <= greatest(small // 2, 2) then true
    else case when small = 0 then 0.0 else c * 1.0 / (len(s) + len(t) - c) end >= 0.85 end as reword from q"""


@query(_REWORD)
def f4_reword_of_newer(spark, sf):
    """Whether a superseded memory only rewords its successor."""
    n = nodes(spark, sf, "id", "title", "body", "superseded_by")
    b = n.select(F.col("id").alias("superseded_by"), F.col("body").alias("new"))
    return n.filter("superseded_by is not null").join(b, "superseded_by").select("id", X.is_reword("body", "new").alias("reword"))


@query("""with v(s) as (select unnest(['3h', '2d', '1w', '5m', '1y', 'x', '', '12', '4 d']) ), p as (select s, regexp_extract(s, '^(\\d{1,9})([hdwmy])$', 1) as n, regexp_extract(s, '^(\\d{1,9})([hdwmy])$', 2) as u from v)
  select s, case when u in ('h', 'd', 'w') then try_cast(n as bigint) * case u when 'h' then 3600 when 'd' then 86400 else 604800 end end as expires,
    case when u <> '' then try_cast(n as bigint) * case u when 'h' then 3600 when 'd' then 86400 when 'w' then 604800 when 'm' then 2592000 else 31536000 end end as since from p""")
def f13_durations(spark, sf):
    v = spark.createDataFrame([(s,) for s in ("3h", "2d", "1w", "5m", "1y", "x", "", "12", "4 d")], "s string")
    return v.select("s", X.parse_expires("s").alias("expires"), X.parse_since("s").alias("since"))


@query("""with v(s) as (select unnest(['2024-02-29', '2023-02-29', '2024-2-9', 'today', '2024-13-01'])) select s, strftime(try_strptime(s, '%Y-%m-%d'), '%Y-%m-%d') = s as ok from v where strftime(try_strptime(s, '%Y-%m-%d'), '%Y-%m-%d') = s""")
def f14_parse_date(spark, sf):
    v = spark.createDataFrame([(s,) for s in ("2024-02-29", "2023-02-29", "2024-2-9", "today", "2024-13-01")], "s string")
    return v.filter(X.parse_date("s").isNotNull()).select("s", X.parse_date("s").isNotNull().alias("ok"))


@query()
def f16_snippets(spark, sf):
    n = nodes(spark, sf, "id", "kind", "body").filter("kind = 'memory' and body is not null")
    return n.select("id", X.snippet("body", ["retention", "index"]).alias("snippet"))


@query(f"select id, len(list_distinct(list_filter({_TOK.format('title')}, lambda x: length(x) > 3))) as words from node where kind = 'memory'")
def f22_significant_words(spark, sf):
    return nodes(spark, sf, "id", "kind", "title").filter("kind = 'memory'").select("id", F.size(X.significant_words("title")).cast("long").alias("words"))


@query("select id, round(least(greatest(length(coalesce(body, '')) * 50 / 8.0 / 200000.0 * 100.0, 0.0), 100.0), 0) as pct from node where kind = 'chunk'")
def f24_estimate_pct(spark, sf):
    return nodes(spark, sf, "id", "kind", "body").filter("kind = 'chunk'").select("id", X.estimate_pct(F.length(F.coalesce("body", F.lit(""))) * 50).alias("pct"))


_SHELL = r"[|&;<>`$]"


@query(r"""select doc_id, no, not regexp_matches(line, '[|&;<>`$]') and not regexp_matches(line, '(^|\s)(-f|--follow|--watch)(\s|$)') as eligible from (with """ + _LINES + r""" select * from ln) where regexp_matches(line, '^\s*(run|git|cargo|npm|docker) ')""")
def f27_rewrite_eligible(spark, sf):
    """Commands that a filter may run for the user: no shell signs, nothing that follows."""
    c = lines_of_commands(spark, sf)
    ok = ~F.col("line").rlike(_SHELL) & ~F.col("line").rlike(r"(^|\s)(-f|--follow|--watch)(\s|$)")
    return c.select("doc_id", "no", ok.alias("eligible"))


def lines_of_commands(spark, sf):
    from stratalog.plans.report_queries import lines_of

    return lines_of(spark, sf).filter(F.col("line").rlike(r"^\s*(run|git|cargo|npm|docker) "))


@query(r"""select id, subkind || ' ' || right(uid, 6) || case when (1765000000 - created_at) // 86400 > 90 then ' (' || ((1765000000 - created_at) // 86400 // 30)::varchar || ' months)' else '' end as line
  from node where kind = 'memory' and subkind in ('gotcha', 'decision')""")
def f33_brief_line(spark, sf):
    n = nodes(spark, sf, "id", "uid", "kind", "subkind", "created_at").filter("kind = 'memory' and subkind in ('gotcha', 'decision')")
    days = F.floor((NOW - F.col("created_at")) / DAY)
    age = F.when(days > 90, F.concat(F.lit(" ("), F.floor(days / 30).cast("string"), F.lit(" months)"))).otherwise("")
    return n.select("id", F.concat("subkind", F.lit(" "), F.substring("uid", -6, 6), age).alias("line"))


@query("""select source, case when b >= 1048576 then printf('%.1f MB', b / 1048576.0) when b >= 1024 then printf('%.1f KB', b / 1024.0) else printf('%d B', b) end as size from (select source, sum(n_chars)::bigint as b from documents where source is not null group by 1)""")
def f34_human_bytes(spark, sf):
    d = load(spark, sf, "documents").filter("source is not null").groupBy("source").agg(F.sum("n_chars").alias("b"))
    return d.select("source", X.human_bytes("b").alias("size"))


@query(f"""with {EVENT_SQL}, p as (select node_id, count(*) filter (event = 'shown') >= 3 as fired, count(*) filter (event in ('opened', 'useful')) >= 3 as used from ev group by 1) select fired, used, count(*) as n from p group by 1, 2""")
def a29_confusion(spark, sf):
    """Nodes shown often against nodes used often: the four cells."""
    e = F.col("event")
    p = recall_event(spark, sf).groupBy("node_id").agg((F.count(F.when(e == "shown", 1)) >= 3).alias("fired"), (F.count(F.when(e.isin("opened", "useful"), 1)) >= 3).alias("used"))
    return p.groupBy("fired", "used").agg(F.count("*").alias("n"))


_RANK = f"""{EVENT_SQL}, r as (select query_hash, node_id, row_number() over (partition by query_hash order by score desc, id) as rank, event in ('opened', 'useful') as relevant from ev)"""


@query(f"""with {_RANK}, q as (select query_hash, count(*) filter (relevant and rank <= 5) / 5.0 as p5, count(*) filter (relevant and rank <= 5) * 1.0 / nullif(count(*) filter (relevant), 0) as recall5, coalesce(1.0 / min(case when relevant then rank end), 0) as rr from r group by 1)
  select round(avg(p5), 6) as p5, round(avg(recall5), 6) as recall5, round(avg(rr), 6) as mrr, count(*) as queries from q""")
def a27_retrieval_metrics(spark, sf):
    """Precision and recall at five and mean reciprocal rank over the recorded queries."""
    w = Window.partitionBy("query_hash").orderBy(F.desc("score"), "id")
    r = recall_event(spark, sf).select("query_hash", F.row_number().over(w).alias("rank"), F.col("event").isin("opened", "useful").alias("relevant"))
    hit = F.count(F.when(F.col("relevant") & (F.col("rank") <= 5), 1))
    q = r.groupBy("query_hash").agg(
        (hit / 5.0).alias("p5"), (hit / F.nullif(F.count(F.when(F.col("relevant"), 1)), F.lit(0))).alias("recall5"), F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("rr")
    )
    return q.agg(F.round(F.avg("p5"), 6).alias("p5"), F.round(F.avg("recall5"), 6).alias("recall5"), F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("queries"))


@query(f"""with {EVENT_SQL}, r as (select query_hash, node_id, event, row_number() over (partition by query_hash order by at, id) as live, row_number() over (partition by query_hash order by score desc, id) as shadow from ev),
  p as (select query_hash, min(case when event = 'useful' then live end) as l, min(case when event = 'useful' then shadow end) as s from r group by 1)
  select count(*) as pages, count(l) as decided, count(*) filter (s < l) as wins, count(*) filter (s > l) as losses, count(*) filter (s = l) as ties, round(avg(1.0 / l), 6) as mrr_live, round(avg(1.0 / s), 6) as mrr_shadow from p""")
def a30_shadow_evaluation(spark, sf):
    """Pages in the order shown against the order of scores, judged by the first useful hit."""
    live = F.row_number().over(Window.partitionBy("query_hash").orderBy("at", "id"))
    shadow = F.row_number().over(Window.partitionBy("query_hash").orderBy(F.desc("score"), "id"))
    r = recall_event(spark, sf).select("query_hash", "event", live.alias("live"), shadow.alias("shadow"))
    good = F.col("event") == "useful"
    p = r.groupBy("query_hash").agg(F.min(F.when(good, F.col("live"))).alias("l"), F.min(F.when(good, F.col("shadow"))).alias("s"))
    n = lambda c: F.count(F.when(c, 1))
    lo, s = F.col("l"), F.col("s")
    return p.agg(
        F.count("*").alias("pages"), F.count("l").alias("decided"), n(s < lo).alias("wins"), n(s > lo).alias("losses"), n(s == lo).alias("ties"),
        F.round(F.avg(1.0 / lo), 6).alias("mrr_live"), F.round(F.avg(1.0 / s), 6).alias("mrr_shadow"),
    )


@query("""with r as (select uid, updated_at, title, feed_id from sync_record where uid is not null and title is not null) select uid, min_by(title, updated_at * 1000000 + feed_id) as title from r where updated_at > 1700000000 group by 1""")
def w5_text_at(spark, sf):
    """The earliest wording of each record written after a time."""
    r = load(spark, sf, "sync_record").filter("uid is not null and title is not null and updated_at > 1700000000")
    return r.groupBy("uid").agg(F.min_by("title", F.col("updated_at") * 1_000_000 + F.col("feed_id")).alias("title"))


@query(f"""with {_LINES}, {_TURN}, c as (select conv, turn, sum(tokens) over (partition by conv order by turn) as used, tokens from tn)
  select conv, turn, (used // 100 * 10)::bigint as band from c where used // 100 > (used - tokens) // 100""")
def w6_nag(spark, sf):
    """Turns at which the use of a session's window enters another band."""
    c = turns(spark, sf).withColumn("used", F.sum("tokens").over(Window.partitionBy("conv").orderBy("turn")))
    band = lambda x: F.floor(x / 100)
    c = c.filter(band(F.col("used")) > band(F.col("used") - F.col("tokens")))
    return c.select("conv", "turn", (band(F.col("used")) * 10).alias("band"))


@query(f"with {EVENT_SQL} select query_hash, count(*) as n, max(at) as last_at from ev where event = 'not_useful' group by 1 order by 2 desc, 3 desc, 1 limit 20")
def t6_misses(spark, sf):
    e = recall_event(spark, sf).filter("event = 'not_useful'")
    return e.groupBy("query_hash").agg(F.count("*").alias("n"), F.max("at").alias("last_at")).orderBy(F.desc("n"), F.desc("last_at"), "query_hash").limit(20)


@query(f"with {MUTATION_SQL} select node_id, at as dated from mu order by at desc, node_id desc limit 50")
def t8_recent_mutations(spark, sf):
    return supersede_ledger(spark, sf).orderBy(F.desc("at"), F.desc("node_id")).limit(50).select("node_id", F.col("at").alias("dated"))


@query(_GROUND + " select t.id, n.created_at from t join node n on n.id = t.id where status = 'stale' order by n.created_at desc, t.id limit 20")
def t9_stale_newest(spark, sf):
    s = grounding(spark, sf).filter("status = 'stale'").join(nodes(spark, sf, "id", "created_at"), "id")
    return s.orderBy(F.desc("created_at"), "id").limit(20).select("id", "created_at")


@query(f"""with {EVENT_SQL}, s as (select id, node_id, at from ev where event = 'shown'), v as (select id, node_id, at from ev where event = 'useful') select v.id, count(*) as pages from v join s on s.node_id = v.node_id and abs(s.at - v.at) <= 3600 group by 1""")
def j17_tolerance(spark, sf):
    """Verdicts with the pages of their node within an hour."""
    e = recall_event(spark, sf)
    v = e.filter("event = 'useful'").select("id", "node_id", "at")
    s = e.filter("event = 'shown'").select("node_id", F.col("at").alias("t"))
    return v.join(s, "node_id").filter(F.abs(F.col("t") - F.col("at")) <= 3600).groupBy("id").agg(F.count("*").alias("pages"))


_GLOBS = ("src/*.rs", "docs/*", "*_test.py", "crates/?al*/*")


@query("with g(p, r) as (values " + ", ".join(f"('{g}', '{X.glob_regex(g)}')" for g in _GLOBS) + ") select g.p as anchor, count(*) as files from node join g on regexp_matches(node.path, g.r) where kind = 'file' group by 1")
def j20_glob_join(spark, sf):
    """Files per anchor; the anchors are few and become one array of patterns."""
    hits = F.array(*[F.when(F.col("path").rlike(X.glob_regex(g)), F.lit(g)) for g in _GLOBS])
    n = nodes(spark, sf, "kind", "path").filter("kind = 'file'").select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("anchor"))
    return n.groupBy("anchor").agg(F.count("*").alias("files"))


@query(f"""with {EDGE_SQL}, top as (select id from (select src as id from ed union all select dst from ed) group by 1 order by count(*) desc, 1 limit 200) select ed.id, src, dst, rel from ed where src in (select id from top) and dst in (select id from top)""")
def g10_subgraph(spark, sf):
    """The edges among the two hundred nodes of highest degree."""
    e = edges(spark, sf)
    top = e.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").agg(F.count("*").alias("d")).orderBy(F.desc("d"), "n").limit(200)
    e = e.join(top.select(F.col("n").alias("src")), "src", "left_semi").join(top.select(F.col("n").alias("dst")), "dst", "left_semi")
    return e.select("id", "src", "dst", "rel")


@query("""with s as (select distinct node_id, name from symbol_def where name is not null) select name, count(*) as total, min(node_id) as first, case when count(*) = 1 then 'found' else 'ambiguous' end as status from s group by 1""")
def g12_symbol_resolve(spark, sf):
    s = load(spark, sf, "symbol_def").filter("name is not null").select("node_id", "name").distinct()
    n = F.count("*")
    return s.groupBy("name").agg(n.alias("total"), F.min("node_id").alias("first"), F.when(n == 1, "found").otherwise("ambiguous").alias("status"))


@query(f"""with {EDGE_SQL}, b as (select src as node, dst as other, weight, created_at from ed where rel = 'co_recalled' union all select dst, src, weight, created_at from ed where rel = 'co_recalled'),
  w as (select node, other, weight * power(2, -greatest({NOW} - created_at, 0) / 86400.0 / 3650) as w from b) select node, other, round(w, 6) as weight from w where w >= 0.3""")
def g16_partners(spark, sf):
    """Co-recalled partners whose decayed weight is still high."""
    e = edges(spark, sf).filter("rel = 'co_recalled'")
    b = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight", "created_at").unionAll(e.select("dst", "src", "weight", "created_at"))
    w = F.col("weight") * F.pow(F.lit(2.0), -F.greatest(NOW - F.col("created_at"), F.lit(0)) / float(DAY) / 3650.0)
    return b.select("node", "other", w.alias("w")).filter("w >= 0.3").select("node", "other", F.round("w", 6).alias("weight"))


@query(f"select id, {NOW}::bigint as deleted_at from node where kind = 'memory' and subkind = 'idea' and deleted_at is null union all select id, deleted_at from node where not coalesce(kind = 'memory' and subkind = 'idea' and deleted_at is null, false)")
def m4_soft_delete(spark, sf):
    """The table after all ideas were forgotten; earlier deletions keep their time."""
    n = nodes(spark, sf, "id", "kind", "subkind", "deleted_at", "updated_at")
    return M.latest(n, M.soft_delete(n, (F.col("kind") == "memory") & (F.col("subkind") == "idea"), NOW)).select("id", "deleted_at")


@query(f"""select id, coalesce(superseded_by, case when kind = 'memory' and not pinned and superseded_by is null then id + 1 end) as superseded_by from node""")
def m5_supersede(spark, sf):
    n = nodes(spark, sf, "id", "kind", "pinned", "superseded_by", "updated_at")
    pairs = n.filter("kind = 'memory' and superseded_by is null").select(F.col("id").alias("old"), (F.col("id") + 1).alias("new"))
    return M.latest(n, M.supersede(n, pairs, NOW)).select("id", "superseded_by")


@query("select id, body || ' edited' as body, substr(body, 1, 0) as nothing from node where kind = 'annotation' and body is not null union all select id, body, case when body is not null then '' end from node where not (kind = 'annotation' and body is not null)")
def m3_edit(spark, sf):
    n = nodes(spark, sf, "id", "kind", "title", "body", "meta", "content_hash", "updated_at")
    new, _ = M.edit(n, n.filter("kind = 'annotation' and body is not null").select("id", F.concat("body", F.lit(" edited")).alias("new_body")), NOW)
    return M.latest(n, new).select("id", "body", F.when(F.col("body").isNotNull(), "").alias("nothing"))


@query(f"""with k as (select sha256(array_to_string({_TOK.format('body')}, ' ')) as h, max(case when deleted_at is null then 1 else 0 end) as live from node where kind = 'memory' group by 1),
  i as (select distinct feed_id, body from sync_record), j as (select feed_id, sha256(array_to_string({_TOK.format('body')}, ' ')) as h from i), n as (select *, row_number() over (partition by h order by feed_id) as r from j)
  select feed_id as key, case when k.live = 1 then 'duplicate' when k.live = 0 then 'forgotten' when r > 1 then 'duplicate' else 'stored' end as status from n left join k using (h)""")
def m2_remember(spark, sf):
    """What remembering every change of the feed would do."""
    items = load(spark, sf, "sync_record").select(F.col("feed_id").alias("key"), "body").distinct()
    return M.remember(nodes(spark, sf, "kind", "body", "deleted_at"), items)


@query(f"select id, '{{\"stage\":\"done\"}}' as stage from node where kind = 'memory'")
def m7_meta_set(spark, sf):
    """A key set in the meta of all memories, and what it reads as alone."""
    n = nodes(spark, sf, "id", "kind", "meta").filter("kind = 'memory'")
    stage = P.meta("stage", "m")
    return n.select("id", X.meta_set("meta", "stage", F.lit("done")).alias("m")).select("id", F.to_json(F.struct(stage.alias("stage"))).alias("stage"))


@query("""with v as (select uid, feed_id, title, updated_at from sync_record where uid is not null) select uid, title from (select *, row_number() over (partition by uid order by updated_at desc nulls last, feed_id desc) as r from v) where r = 1""")
def m14_latest_value(spark, sf):
    v = load(spark, sf, "sync_record").filter("uid is not null").select("uid", F.col("feed_id").alias("id"), "title", F.coalesce("updated_at", F.lit(-1)).alias("at"))
    return M.put(v, "uid").select("uid", "title")


@query(f"select id from node where (id = (select min(id) from node where kind = 'collection') or collection_id = (select min(id) from node where kind = 'collection')) and deleted_at is null")
def m15_remove_collection(spark, sf):
    """A collection and all it owns, as far as they live."""
    n = nodes(spark, sf, "id", "kind", "collection_id", "deleted_at", "updated_at")
    first = n.filter("kind = 'collection'").agg(F.min("id").alias("c")).first()["c"]
    return M.soft_delete(n, (F.col("id") == F.lit(first)) | F.coalesce(F.col("collection_id") == F.lit(first), F.lit(False)), NOW).select("id")


@query("""select title, min_by(id, case when path is not null then 0 else 1 end * 1000000 + id) as id, count(*) as n from project group by 1""")
def m17_project_by_title(spark, sf):
    p = load(spark, sf, "project")
    best = F.when(F.col("path").isNotNull(), 0).otherwise(1) * 1_000_000 + F.col("id")
    return p.groupBy("title").agg(F.min_by("id", best).alias("id"), F.count("*").alias("n"))


@query(_GROUND + f""", x as (select id, 'stale-grounding' as finding from t where status = 'stale' union all select id, 'unresolved' from node where kind = 'memory' and deleted_at is null and superseded_by is null and coalesce(last_accessed, created_at) < {NOW} - 730 * 86400)
  select finding, count(*) as n from x group by 1""")
def m10_review_scan(spark, sf):
    """What a review would put into its queue."""
    stale = grounding(spark, sf).filter("status = 'stale'").select(F.lit("stale-grounding").alias("finding"))
    n = nodes(spark, sf, "kind", "deleted_at", "superseded_by", "last_accessed", "created_at").filter(P.live_memory())
    old = n.filter(F.coalesce("last_accessed", "created_at") < NOW - 730 * DAY).select(F.lit("unresolved").alias("finding"))
    return stale.unionAll(old).groupBy("finding").agg(F.count("*").alias("n"))


@query(f"with {EVENT_SQL}, s as (select node_id, max(at) as last from ev where event = 'shown' group by 1) select node_id from s where last >= (select max(last) from s) - 6 * 3600")
def e12_suppressed(spark, sf):
    """What was shown in the six hours before the last page and is held back."""
    s = recall_event(spark, sf).filter("event = 'shown'").groupBy("node_id").agg(F.max("at").alias("last"))
    return s.crossJoin(F.broadcast(s.agg(F.max("last").alias("now")))).filter("last >= now - 6 * 3600").select("node_id")


@query(f"""with {EVENT_SQL}, x as (select node_id, at, at - lag(at) over (partition by node_id order by at, id) as gap from ev), y as (select node_id, at, sum(case when gap is null or gap > 86400 then 1 else 0 end) over (partition by node_id order by at rows between unbounded preceding and current row) as session from x)
  select node_id, count(distinct session) as sessions from y group by 1""")
def e6_sessions(spark, sf):
    """Sessions of use per node: a day without an event ends one."""
    w = Window.partitionBy("node_id").orderBy("at", "id")
    x = recall_event(spark, sf).withColumn("gap", F.col("at") - F.lag("at").over(w))
    first = F.when(F.col("gap").isNull() | (F.col("gap") > DAY), 1).otherwise(0)
    return x.groupBy("node_id").agg(F.sum(first).alias("sessions"))


_EMBED = """with d as (select content_hash, count(*) as n from embedding where vec is not null and content_hash is not null and len(vec) = 64 group by 1)
  select n.id as node_id, d.n is not null as copied from node n left join d using (content_hash) where n.kind = 'memory' and n.deleted_at is null and n.body is not null and n.content_hash is not null"""


@query(_EMBED)
def r20_embed_pending(spark, sf):
    """Which memories get a vector by copy and which by the embedder."""
    from stratalog.operators.inject import embed_pending, hash_embedder

    n = nodes(spark, sf, "id", "kind", "body", "content_hash", "deleted_at").filter("kind = 'memory' and deleted_at is null and body is not null and content_hash is not null")
    donors = load(spark, sf, "embedding").filter("vec is not null and content_hash is not null and size(vec) = 64").select("content_hash", "vec")
    return embed_pending(n.select("id", "content_hash", "body"), donors, hash_embedder()).select("node_id", "copied")


@query("select id from node where kind = 'memory' and deleted_at is null and tags_text <> '' and len(list_filter(string_split(tags_text, ' '), lambda x: length(x) > 3 and contains('the default retention of the shared index moved', x))) > 0")
def r16_fires(spark, sf):
    """Memories of which a tag, read as a trigger phrase, fires on the flagship's text."""
    from stratalog.operators.inject import fires
    from stratalog.plans.search_queries import QUERY

    n = nodes(spark, sf, "id", "kind", "tags_text", "deleted_at").filter("kind = 'memory' and deleted_at is null and tags_text <> ''")
    n = n.withColumn("phrases", F.filter(F.split("tags_text", " "), lambda x: F.length(x) > 3))
    return n.filter(fires("phrases", QUERY)).select("id")


@query("""with f as (select distinct file_id, path, content from source_file where content is not null and lang = 'rust'), i as (select file_id, unnest(regexp_extract_all(content, 'use crate::([a-z_0-9]+)::', 1)) as module from f)
  select module, count(distinct file_id) as files from i group by 1""")
def g9_imports(spark, sf):
    """Modules by the Rust files that import from them."""
    f = load(spark, sf, "source_file").filter("content is not null and lang = 'rust'").select("file_id", "content").distinct()
    i = f.select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r"use crate::([a-z_0-9]+)::"), F.lit(1))).alias("module"))
    return i.groupBy("module").agg(F.countDistinct("file_id").alias("files"))


@query()
def g9_import_resolution(spark, sf):
    """Every import of the four languages and the file it leads to, null if none."""
    from stratalog.operators.imports import resolve

    return resolve(load(spark, sf, "source_file"))


@query("select machine, max(greatest(updated_at, coalesce(deleted_at, 0))) as newest, greatest(0, least(max(greatest(updated_at, coalesce(deleted_at, 0))), 1765000000) - 60) as next_pull from sync_record where updated_at is not null group by 1")
def y3_cursors(spark, sf):
    """Where the next pull from each peer begins."""
    newest = F.max(F.greatest("updated_at", F.coalesce("deleted_at", F.lit(0))))
    r = load(spark, sf, "sync_record").filter("updated_at is not null").groupBy("machine").agg(newest.alias("newest"))
    return r.select("machine", "newest", F.greatest(F.lit(0), F.least("newest", F.lit(NOW)) - 60).alias("next_pull"))


@query("""select k.id, coalesce(k.n, 0) as kids from (select p.id, count(c.id) as n from node p left join node c on c.parent_id = p.id and c.deleted_at is null where p.kind = 'file' group by 1) k""")
def c9_outline_sizes(spark, sf):
    """Live children of every file."""
    p = nodes(spark, sf, "id", "kind").filter("kind = 'file'").select("id")
    c = nodes(spark, sf, "parent_id", "deleted_at").filter("parent_id is not null and deleted_at is null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    return p.join(c, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("kids"))
