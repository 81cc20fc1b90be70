"""Aggregations, windows, limits and event-stream state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import ledger as L
from stratalog.operators import predicates as P
from stratalog.plans.bindings import DAY, EDGE_SQL, EVENT_SQL, MUTATION_SQL, NOW, SAVINGS_SQL, edges, nodes, recall_event, savings_event, supersede_ledger
from stratalog.plans.registry import query
from stratalog.tables import load

#: Ends of the ledgers, from which the windows of the reports count back.
EV_NOW, SV_NOW = 1_706_745_600, 1_704_067_200
PERIODS = {"day": 1, "week": 7, "month": 30, "year": 365}


@query("select kind, count(*) as n from node where deleted_at is null group by 1")
def a1_kind_counts(spark, sf):
    return nodes(spark, sf, "kind", "deleted_at").filter(P.live()).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""with {EVENT_SQL} select node_id, count(*) filter (event = 'shown') as shown, count(*) filter (event = 'opened') as opened,
  max(case when event = 'shown' then at end) as last_shown from ev group by 1""")
def a2_impressions(spark, sf):
    shown = F.col("event") == "shown"
    return recall_event(spark, sf).groupBy("node_id").agg(
        F.count(F.when(shown, 1)).alias("shown"), F.count(F.when(F.col("event") == "opened", 1)).alias("opened"), F.max(F.when(shown, F.col("at"))).alias("last_shown")
    )


def _by_period(col, at, now):
    return [F.sum(F.when(F.col(at) >= now - d * DAY, col)).alias(p) for p, d in PERIODS.items()] + [F.sum(col).alias("all")]


_PERIOD_SQL = ", ".join(f"sum(case when at >= {SV_NOW} - {d} * 86400 then {{0}} end)::bigint as {p}" for p, d in PERIODS.items()) + ', sum({0})::bigint as "all"'


@query(f"with {SAVINGS_SQL} select source, {_PERIOD_SQL.format('greatest(tokens_before - tokens_after, 0)')} from sv where source <> 'brief' group by 1")
def a4_savings_periods(spark, sf):
    s = savings_event(spark, sf).filter("source <> 'brief'")
    return s.groupBy("source").agg(*_by_period(F.greatest(F.col("tokens_before") - F.col("tokens_after"), F.lit(0)), "at", SV_NOW))


@query(f"with {SAVINGS_SQL} select source, {_PERIOD_SQL.format('tokens_after - tokens_before')} from sv where source = 'brief' group by 1")
def a5_spend_periods(spark, sf):
    return savings_event(spark, sf).filter("source = 'brief'").groupBy("source").agg(*_by_period(F.col("tokens_after") - F.col("tokens_before"), "at", SV_NOW))


@query(f"with {SAVINGS_SQL} select count(*) as events, sum(tokens_before)::bigint as before, sum(tokens_after)::bigint as after from sv where at >= {SV_NOW} - 365 * 86400")
def a6_totals_since(spark, sf):
    return savings_event(spark, sf).filter(F.col("at") >= SV_NOW - 365 * DAY).agg(F.count("*").alias("events"), F.sum("tokens_before").alias("before"), F.sum("tokens_after").alias("after"))


@query(f"with {SAVINGS_SQL} select source, count(*) as events, sum(tokens_before - tokens_after)::bigint as saved, round(greatest(sum(tokens_before - tokens_after), 0) * 3.0 / 1000000, 4) as dollars from sv group by 1")
def a7_by_source(spark, sf):
    saved = F.sum(F.col("tokens_before") - F.col("tokens_after"))
    return savings_event(spark, sf).groupBy("source").agg(F.count("*").alias("events"), saved.alias("saved"), F.round(F.greatest(saved, F.lit(0)) * 3.0 / 1_000_000, 4).alias("dollars"))


@query(f"with {SAVINGS_SQL} select at // 86400 as day, sum(tokens_before - tokens_after)::bigint as saved from sv where source <> 'brief' group by 1")
def a8_daily_saved(spark, sf):
    s = savings_event(spark, sf).filter("source <> 'brief'")
    return s.groupBy(F.floor(F.col("at") / DAY).alias("day")).agg(F.sum(F.col("tokens_before") - F.col("tokens_after")).alias("saved"))


@query(f"""with {EVENT_SQL}, m as (select 'events' as metric, at from ev union all select 'opened', at from ev where event = 'opened' union all select 'useful', at from ev where event = 'useful'
    union all select 'created', created_at from node where kind = 'memory' union all select 'deleted', deleted_at from node where kind = 'memory' and deleted_at is not null)
  select metric, """ + ", ".join(f"count(*) filter (at >= {NOW} - {d} * 86400) as {p}" for p, d in PERIODS.items()) + ', count(*) as "all" from m group by 1')
def a10_activity(spark, sf):
    ev = recall_event(spark, sf).select("event", "at")
    n = nodes(spark, sf, "kind", "created_at", "deleted_at").filter("kind = 'memory'")
    parts = [
        ev.select(F.lit("events").alias("metric"), "at"),
        ev.filter("event in ('opened', 'useful')").select(F.col("event").alias("metric"), "at"),
        n.select(F.lit("created").alias("metric"), F.col("created_at").alias("at")),
        n.filter("deleted_at is not null").select(F.lit("deleted").alias("metric"), F.col("deleted_at").alias("at")),
    ]
    m = parts[0]
    for p in parts[1:]:
        m = m.unionAll(p)
    return m.groupBy("metric").agg(*[F.count(F.when(F.col("at") >= NOW - d * DAY, 1)).alias(p) for p, d in PERIODS.items()], F.count("*").alias("all"))


@query(f"with {EVENT_SQL} select " + ", ".join(f"count(distinct case when at >= {EV_NOW} - {d} * 86400 then query_hash end) as {p}" for p, d in PERIODS.items()) + " from ev")
def a11_distinct_searches(spark, sf):
    return recall_event(spark, sf).agg(*[F.countDistinct(F.when(F.col("at") >= EV_NOW - d * DAY, F.col("query_hash"))).alias(p) for p, d in PERIODS.items()])


@query(f"with {EVENT_SQL} select node_id, count(*) as opened from ev join node on node.id = ev.node_id where event in ('opened', 'useful') and at >= {EV_NOW} - 30 * 86400 group by 1 order by 2 desc, 1 limit 3")
def a12_top_recalled(spark, sf):
    e = recall_event(spark, sf).filter(F.col("event").isin("opened", "useful") & (F.col("at") >= EV_NOW - 30 * DAY))
    n = nodes(spark, sf, "id").select(F.col("id").alias("node_id"))
    return e.join(n, "node_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("opened")).orderBy(F.desc("opened"), "node_id").limit(3)


@query("select coalesce(subkind, 'note') as type, count(*) as n from node where kind = 'memory' and deleted_at is null and superseded_by is null group by 1")
def a13_memory_types(spark, sf):
    n = nodes(spark, sf, "kind", "subkind", "deleted_at", "superseded_by").filter(P.live_memory())
    return n.groupBy(F.coalesce("subkind", F.lit("note")).alias("type")).agg(F.count("*").alias("n"))


@query(f"""with {EVENT_SQL}, days as (select unnest(range({EV_NOW} // 86400 - 13, {EV_NOW} // 86400 + 1)) as day)
  select d.day, count(*) filter (event = 'shown') as shown, count(*) filter (event in ('opened', 'useful')) as opened from days d left join ev on ev.at // 86400 = d.day group by 1""")
def a14_two_weeks(spark, sf):
    today = EV_NOW // DAY
    days = spark.range(today - 13, today + 1).select(F.col("id").alias("day"))
    e = recall_event(spark, sf).select(F.floor(F.col("at") / DAY).alias("day"), "event").filter(F.col("day") > today - 14)
    per = e.groupBy("day").agg(F.count(F.when(F.col("event") == "shown", 1)).alias("shown"), F.count(F.when(F.col("event").isin("opened", "useful"), 1)).alias("opened"))
    return days.join(per, "day", "left").select("day", F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("opened", F.lit(0)).alias("opened"))


_HALF = "case when kind <> 'memory' then null when subkind = 'gotcha' then 180 when subkind = 'decision' then 365 when subkind = 'insight' then 120 when subkind is null or subkind = 'note' then 90 when subkind = 'idea' then 60 end"
_EFF = f"(case when pinned or ({_HALF}) is null then strength else strength * power(2, -greatest({NOW} - coalesce(last_accessed, created_at), 0) / 86400.0 / ({_HALF})) end)"


@query(f"select id, round({_EFF}, 6) as effective from node where kind = 'memory'")
def r8_effective_strength(spark, sf):
    n = nodes(spark, sf, "id", "kind", "subkind", "strength", "pinned", "last_accessed", "created_at").filter("kind = 'memory'")
    return n.select("id", F.round(L.effective_strength(NOW), 6).alias("effective"))


@query(f"""select cohort, count(*) as n from (select case when e < 0.25 then 'a_fading' when e < 0.6 then 'b_weak' when e < 1.2 then 'c_steady' when e < 2.5 then 'd_strong' else 'e_core' end as cohort
  from (select {_EFF} as e from node where kind = 'memory' and deleted_at is null and superseded_by is null)) group by 1""")
def a15_strength_cohorts(spark, sf):
    n = nodes(spark, sf, "id", "kind", "subkind", "strength", "pinned", "last_accessed", "created_at", "deleted_at", "superseded_by").filter(P.live_memory())
    e = L.effective_strength(NOW)
    cohort = F.when(e < 0.25, "a_fading").when(e < 0.6, "b_weak").when(e < 1.2, "c_steady").when(e < 2.5, "d_strong").otherwise("e_core")
    return n.groupBy(cohort.alias("cohort")).agg(F.count("*").alias("n"))


@query("select id, kind, access_count from node where kind in ('memory', 'symbol', 'file') and deleted_at is null order by access_count desc, last_accessed desc nulls last, id limit 6")
def a16_most_accessed(spark, sf):
    n = nodes(spark, sf, "id", "kind", "access_count", "last_accessed", "deleted_at").filter(F.col("kind").isin("memory", "symbol", "file") & P.live())
    return n.orderBy(F.desc("access_count"), F.desc_nulls_last("last_accessed"), "id").limit(6).select("id", "kind", "access_count")


@query("select coalesce(p.title, 'global') as project, count(*) as n from node left join project p on p.id = node.project_id where kind = 'memory' and node.deleted_at is null group by 1 order by 2 desc, 1 limit 6")
def a17_projects(spark, sf):
    p = load(spark, sf, "project").select(F.col("id").alias("project_id"), F.col("title").alias("t"))
    n = nodes(spark, sf, "kind", "project_id", "deleted_at").filter("kind = 'memory' and deleted_at is null")
    return n.join(p, "project_id", "left").groupBy(F.coalesce("t", F.lit("global")).alias("project")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(6)


@query(f"""with {EDGE_SQL} select count(*) filter (rel = 'calls' and json_extract_string(meta, '$.resolved') = 'heuristic') as heuristic_calls, count(*) filter (rel = 'calls' and coalesce(json_extract_string(meta, '$.resolved'), '') <> 'heuristic') as resolved_calls,
  count(*) filter (rel = 'imports') as imports, count(*) filter (rel in ('links', 'relates')) as links, count(*) filter (rel = 'co_recalled') as co_recalled from ed""")
def a18_edge_counters(spark, sf):
    e, r, h = edges(spark, sf), F.col("rel"), F.coalesce(P.meta("resolved"), F.lit(""))
    n = lambda c: F.count(F.when(c, 1))
    return e.agg(
        n((r == "calls") & (h == "heuristic")).alias("heuristic_calls"), n((r == "calls") & (h != "heuristic")).alias("resolved_calls"), n(r == "imports").alias("imports"),
        n(r.isin("links", "relates")).alias("links"), n(r == "co_recalled").alias("co_recalled"),
    )


_GROUND = f"""with {EDGE_SQL}, b as (select src as m, dst as o from ed where rel in ('about', 'mentions', 'describes') union all select dst, src from ed where rel in ('about', 'mentions', 'describes')),
  g as (select b.m, max(case when n.deleted_at is null then 1 else 0 end) as alive from b join node n on n.id = b.o and n.kind in ('file', 'symbol', 'chunk', 'codechunk') group by 1),
  t as (select id, case when g.alive is null then 'ungrounded' when g.alive = 1 then 'grounded' else 'stale' end as status from node left join g on g.m = node.id where kind = 'memory' and deleted_at is null)"""


def grounding(spark, sf):
    """Status of each live memory: a live artefact on any of its edges beats dead ones."""
    e = edges(spark, sf).filter("rel in ('about', 'mentions', 'describes')")
    b = e.select(F.col("src").alias("id"), F.col("dst").alias("o")).unionAll(e.select("dst", "src"))
    n = nodes(spark, sf, "id", "kind", "deleted_at")
    art = n.filter("kind in ('file', 'symbol', 'chunk', 'codechunk')").select(F.col("id").alias("o"), P.live().alias("alive"))
    g = b.join(art, "o").groupBy("id").agg(F.max("alive").alias("alive"))
    m = n.filter("kind = 'memory' and deleted_at is null").select("id")
    return m.join(g, "id", "left").select("id", F.when(F.col("alive").isNull(), "ungrounded").when(F.col("alive"), "grounded").otherwise("stale").alias("status"))


@query(_GROUND + " select status, count(*) as n from t group by 1")
def a19_grounding(spark, sf):
    return grounding(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(_GROUND + " select id from t where status = 'stale'")
def a20_stale(spark, sf):
    return grounding(spark, sf).filter("status = 'stale'").select("id")


@query("select collection_id, count(*) filter (kind = 'file') as files, count(*) filter (kind in ('chunk', 'codechunk')) as chunks from node where collection_id is not null and deleted_at is null group by 1")
def a22_collections(spark, sf):
    n = nodes(spark, sf, "collection_id", "kind", "deleted_at").filter(F.col("collection_id").isNotNull() & P.live())
    return n.groupBy("collection_id").agg(F.count(F.when(F.col("kind") == "file", 1)).alias("files"), F.count(F.when(F.col("kind").isin("chunk", "codechunk"), 1)).alias("chunks"))


@query(f"with {MUTATION_SQL} select node_id, max(at) as at from mu group by 1")
def a23_supersession_dates(spark, sf):
    return supersede_ledger(spark, sf).groupBy("node_id").agg(F.max("at").alias("at"))


@query("select max(greatest(updated_at, coalesce(deleted_at, 0))) as watermark from node")
def a24_watermark(spark, sf):
    return nodes(spark, sf, "updated_at", "deleted_at").agg(F.max(F.greatest("updated_at", F.coalesce("deleted_at", F.lit(0)))).alias("watermark"))


_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_.\-]+')"


@query(f"""with w as (select project_id, t, count(*) as n from (select project_id, unnest({_TOK.format('title')}) as t from node where kind = 'memory' and project_id is not null)
    where length(t) > 3 and t not in ({', '.join(repr(x) for x in X.STOPWORDS)}) group by 1, 2)
  select project_id, string_agg(t, ' ' order by n desc, t) as theme from (select *, row_number() over (partition by project_id order by n desc, t) as r from w) where r <= 3 group by 1""")
def a26_themes(spark, sf):
    """The three most frequent words of a project's titles."""
    n = nodes(spark, sf, "kind", "project_id", "title").filter("kind = 'memory' and project_id is not null")
    t = n.select("project_id", F.explode(X.tokens("title")).alias("t")).filter((F.length("t") > 3) & ~X.is_stopword("t"))
    per = t.groupBy("project_id", "t").agg(F.count("*").alias("n"))
    top = per.withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), "t"))).filter("r <= 3")
    return top.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), " ").alias("theme"))


@query("""with t as (select tag, count(*) as members from (select id, unnest(list_distinct(string_split(tags_text, ' '))) as tag from node where kind = 'memory' and deleted_at is null and tags_text <> '') where tag <> '' group by 1)
  select tag, members from t where members >= 2""")
def a33_tag_hubs(spark, sf):
    n = nodes(spark, sf, "kind", "deleted_at", "tags_text").filter("kind = 'memory' and deleted_at is null and tags_text <> ''")
    t = n.select(F.explode(F.array_distinct(F.split("tags_text", " "))).alias("tag")).filter("tag <> ''")
    return t.groupBy("tag").agg(F.count("*").alias("members")).filter("members >= 2")


@query(f"""with {EVENT_SQL}, w as (select *, last_value(case when event = 'shown' then {{'h': query_hash, 'at': at}} end ignore nulls) over (partition by node_id order by at, id rows between unbounded preceding and 1 preceding) as page from ev)
  select id, node_id, page.h as query_hash, at - page.at as gap from w where event = 'opened' and page is not null and at - page.at <= 600""")
def j16_verdicts(spark, sf):
    """Each open with the page last shown before it, within ten minutes."""
    return L.verdicts(recall_event(spark, sf), 600).select("id", "node_id", "query_hash", "gap")


@query(f"""with {EVENT_SQL} select a.id, count(distinct b.node_id) as others from ev a join ev b on b.at between a.at - 1800 and a.at and b.node_id <> a.node_id and b.event = 'opened' where a.event = 'opened' group by 1""")
def j18_opened_together(spark, sf):
    """For each open the number of other nodes opened in the half hour before it."""
    opened = recall_event(spark, sf).filter("event = 'opened'").select("id", "node_id", "at")
    return L.within_window(opened, 1800).groupBy("id").agg(F.countDistinct("other").alias("others"))


@query(f"with {EVENT_SQL} select node_id, event, at // 86400 as day, min(id) as first from (select *, row_number() over (partition by node_id, event, at // 86400 order by at, id) as r from ev) where r = 1 group by 1, 2, 3")
def w3_daily_cap(spark, sf):
    """The first event of a kind per node and day."""
    return L.daily_first(recall_event(spark, sf)).select("node_id", "event", "day", F.col("id").alias("first"))


@query(f"""with {EVENT_SQL}, f as (select node_id, event, at, row_number() over (partition by node_id, event, at // 86400 order by at, id) as r from ev where event in ('opened', 'useful', 'not_useful'))
  select node_id, count(*) as steps, round(sum(case event when 'opened' then 0.3 when 'useful' then 1.0 else -1.0 end), 6) as delta from f where r = 1 group by 1""")
def m13_strength_deltas(spark, sf):
    d = F.when(F.col("event") == "opened", 0.3).when(F.col("event") == "useful", 1.0).otherwise(-1.0)
    first = L.daily_first(recall_event(spark, sf).filter("event <> 'shown'"))
    return first.groupBy("node_id").agg(F.count("*").alias("steps"), F.round(F.sum(d), 6).alias("delta"))


_FOLD = f"""with {EVENT_SQL}, f as (select node_id, event, at, id, row_number() over (partition by node_id, event, at // 86400 order by at, id) as r from ev where event <> 'shown')
  select node_id, round(list_reduce(list_prepend(1.0::double, list(case event when 'opened' then 0.3::double when 'useful' then 1.0 else -1.0 end order by at, id)), lambda s, d: least(greatest(s + d, 0.05), 10.0)), 6) as strength
  from f where r = 1 group by 1"""


@query(_FOLD)
def m13_strength_folded(spark, sf):
    """Strength after all marks in order, clamped at every step."""
    return L.fold_strength(recall_event(spark, sf))


@query(f"""with {EDGE_SQL}, b as (select src as node, dst as other, weight, id from ed where rel = 'co_recalled' union all select dst, src, weight, id from ed where rel = 'co_recalled')
  select node, other, weight from (select *, row_number() over (partition by node order by weight desc, other desc, id desc) as r from b) where r <= 32""")
def w4_co_edge_cap(spark, sf):
    e = edges(spark, sf).filter("rel = 'co_recalled'")
    b = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight", "id").unionAll(e.select("dst", "src", "weight", "id"))
    w = Window.partitionBy("node").orderBy(F.desc("weight"), F.desc("other"), F.desc("id"))
    return b.withColumn("r", F.row_number().over(w)).filter("r <= 32").select("node", "other", "weight")


@query("""select id from (select id, row_number() over (partition by title, body order by strength desc, id) as r from node where kind = 'memory' and deleted_at is null) where r = 1""")
def w7_keep_first(spark, sf):
    n = nodes(spark, sf, "id", "title", "body", "strength", "kind", "deleted_at").filter("kind = 'memory' and deleted_at is null")
    w = Window.partitionBy("title", "body").orderBy(F.desc("strength"), "id")
    return n.withColumn("r", F.row_number().over(w)).filter("r = 1").select("id")


_LINES = "ln as (select doc_id, unnest(range(1, len(s) + 1)) as no, unnest(s) as line from (select doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as s from documents where text is not null and text <> ''))"


def lines_of(spark, sf):
    d = load(spark, sf, "documents").filter("text is not null and text <> ''")
    split = F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n", -1)).alias("p", "line")
    return d.select("doc_id", split).select("doc_id", (F.col("p") + 1).cast("long").alias("no"), "line")


@query(f"""with {_LINES} select doc_id, count(*) as kept from (select *, trim(line, ' ') = '' as blank, lag(trim(line, ' ') = '') over (partition by doc_id order by no) as before from ln) where not (blank and coalesce(before, false)) group by 1""")
def w11_blank_runs(spark, sf):
    """Lines left of each document when runs of blank lines become one."""
    b = lines_of(spark, sf).withColumn("blank", F.trim("line") == "")
    b = b.withColumn("before", F.lag("blank").over(Window.partitionBy("doc_id").orderBy("no")))
    return b.filter(~(F.col("blank") & F.coalesce("before", F.lit(False)))).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(f"""with {_LINES}, k as (select *, max(no) over (partition by doc_id) as last from ln)
  select doc_id, count(*) filter (no <= 20 or no > last - 20 or regexp_matches(lower(line), 'error|warning|failed|panic')) as kept, count(*) as lines from k group by 1""")
def w10_head_tail(spark, sf):
    """Head, tail and lines with a signal of each output."""
    k = lines_of(spark, sf).withColumn("last", F.max("no").over(Window.partitionBy("doc_id")))
    keep = (F.col("no") <= 20) | (F.col("no") > F.col("last") - 20) | F.lower("line").rlike("error|warning|failed|panic")
    return k.groupBy("doc_id").agg(F.count(F.when(keep, 1)).alias("kept"), F.count("*").alias("lines"))


@query(f"with {EVENT_SQL} select at // 86400 as day, event, count(*) as n from ev group by 1, 2")
def e5_daily_counts(spark, sf):
    return recall_event(spark, sf).groupBy(F.floor(F.col("at") / DAY).alias("day"), "event").agg(F.count("*").alias("n"))


@query(f"with {EVENT_SQL} select event, count(*) as n from ev where at >= {EV_NOW} - 7 * 86400 group by 1")
def e3_retention(spark, sf):
    return recall_event(spark, sf).filter(F.col("at") >= EV_NOW - 7 * DAY).groupBy("event").agg(F.count("*").alias("n"))


@query(f"""with {EVENT_SQL}, o as (select id, node_id, at from ev where event = 'opened'),
  p as (select distinct least(a.node_id, b.node_id) as src, greatest(a.node_id, b.node_id) as dst, a.at // 86400 as day from o a join o b on b.at between a.at - 1800 and a.at and b.node_id <> a.node_id)
  select src, dst, count(*) as days from p group by 1, 2""")
def e1_pair_days(spark, sf):
    """Days on which two nodes were opened together: the fires of their edge."""
    return L.pair_days(recall_event(spark, sf)).groupBy("src", "dst").agg(F.count("*").alias("days"))


@query()
def e1_co_activation(spark, sf):
    """Weights of the co-activation edges after all fires, decayed between them."""
    return L.co_activation(recall_event(spark, sf))


@query(f"""with {EVENT_SQL}, q as (select query_hash, count(*) as n, min(at) as first_at, max(at) as last_at, max_by(event, at * 1000000 + id) as last from ev where event in ('not_useful', 'useful') group by 1)
  select query_hash, n, first_at, last_at, last = 'not_useful' as open from q""")
def m11_miss_ledger(spark, sf):
    e = recall_event(spark, sf).filter("event in ('not_useful', 'useful')")
    q = e.groupBy("query_hash").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max_by("event", F.col("at") * 1_000_000 + F.col("id")).alias("last"))
    return q.select("query_hash", "n", "first_at", "last_at", (F.col("last") == "not_useful").alias("open"))


@query("""select source, count(*) as offers, count(distinct h) as distinct_texts, min(at) as first_at from (select source, sha256(text) as h, cast(floor(epoch(created_at)) as bigint) as at from documents where text is not null and regexp_matches(text, 'password|token|secret')) group by 1""")
def m12_refusals(spark, sf):
    d = load(spark, sf, "documents").filter("text is not null").filter(F.col("text").rlike("password|token|secret"))
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', created_at)")
    return d.groupBy("source").agg(F.count("*").alias("offers"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"), F.min(at).alias("first_at"))
