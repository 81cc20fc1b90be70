"""Sources, chunks, outlines, filters and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.plans.bindings import DAY, EVENT_SQL
from stratalog.plans.registry import query
from stratalog.plans.report_queries import _FOLD, _LINES, lines_of
from stratalog.sources import chunker
from stratalog.streaming import events as E
from stratalog.tables import load


@query()
def c1_chunks(spark, sf):
    return chunker.chunk_documents(load(spark, sf, "documents"))


@query(f"""with {_LINES}, h as (select doc_id, no, line, sum(case when regexp_matches(line, '^[ \\t]*(```|~~~)') then 1 else 0 end) over (partition by doc_id order by no) as f from ln)
  select doc_id, no, length(regexp_extract(line, '^(#+)', 1))::bigint as level, trim(regexp_replace(line, '^#+[ \\t]+', ''), ' ') as heading from h where f % 2 = 0 and regexp_matches(line, '^#{{1,6}}[ \\t]+[^ \\t]')""")
def f28_outline(spark, sf):
    """Headings of documents outside of fences."""
    h = lines_of(spark, sf)
    fence = F.when(F.col("line").rlike(r"^[ \t]*(```|~~~)"), 1).otherwise(0)
    h = h.withColumn("f", F.sum(fence).over(Window.partitionBy("doc_id").orderBy("no"))).filter(F.col("line").rlike(r"^#{1,6}[ \t]+[^ \t]")).filter("f % 2 = 0")
    return h.select("doc_id", "no", F.length(F.regexp_extract("line", r"^(#+)", 1)).cast("long").alias("level"), F.trim(F.regexp_replace("line", r"^#+[ \t]+", "")).alias("heading"))


@query(r"select doc_id, length(text) as before, length(regexp_replace(replace(regexp_replace(text, '\x1B\[[0-?]*[ -/]*[@-~]', '', 'g'), chr(13) || chr(10), chr(10)), '[^\n]*\r', '', 'g')) as after from documents where text is not null and source = 'tool_output'")
def f25_strip_ansi(spark, sf):
    d = load(spark, sf, "documents").filter("text is not null and source = 'tool_output'")
    return d.select("doc_id", F.length("text").cast("long").alias("before"), F.length(X.strip_ansi("text")).cast("long").alias("after"))


_RULES = {"signal": "error|warning|failed|panic|fatal", "noise": r"^\s*(compiling|downloading|fetching|checking|finished|resolving|unpacking)\b"}


@query(f"""with {_LINES} select verdict, count(*) as lines from (select case when regexp_matches(lower(line), '{_RULES['signal']}') then 'signal' when regexp_matches(lower(line), '{_RULES['noise']}') then 'noise' else 'keep' end as verdict from ln) group by 1""")
def f26_line_verdicts(spark, sf):
    low = F.lower("line")
    v = F.when(low.rlike(_RULES["signal"]), "signal").when(low.rlike(_RULES["noise"]), "noise").otherwise("keep")
    return lines_of(spark, sf).groupBy(v.alias("verdict")).agg(F.count("*").alias("lines"))


_TURN = "tn as (select doc_id as conv, no as turn, line as text, ceil(length(line) / 4.0)::bigint as tokens from ln where doc_id in (select doc_id from documents where source = 'session') and trim(line, ' ') <> '')"


def turns(spark, sf):
    """Lines of sessions as the messages of a conversation."""
    s = load(spark, sf, "documents").filter("source = 'session'").select("doc_id")
    t = lines_of(spark, sf).filter(F.trim("line") != "").join(s, "doc_id", "left_semi")
    return t.select(F.col("doc_id").alias("conv"), F.col("no").alias("turn"), F.col("line").alias("text"), X.estimate_tokens("line").alias("tokens"))


@query(f"with {_LINES}, {_TURN} select conv, sum(tokens)::bigint as tokens, count(*) as messages from tn group by 1")
def f30_request_tokens(spark, sf):
    return turns(spark, sf).groupBy("conv").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("messages"))


@query(f"with {_LINES}, {_TURN} select conv, turn from (select *, row_number() over (partition by conv order by turn desc) as r from tn) where r <= 6")
def w8_recent_tail(spark, sf):
    t = turns(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("turn"))))
    return t.filter("r <= 6").select("conv", "turn")


@query(f"with {_LINES}, {_TURN} select conv, turn, r > 1 as repeated from (select *, row_number() over (partition by conv, sha256(text) order by turn) as r from tn where tokens >= 20)")
def w9_repeated_blocks(spark, sf):
    t = turns(spark, sf).filter("tokens >= 20")
    t = t.withColumn("r", F.row_number().over(Window.partitionBy("conv", F.sha2("text", 256)).orderBy("turn")))
    return t.select("conv", "turn", (F.col("r") > 1).alias("repeated"))


@query(f"""with {_LINES}, {_TURN}, k as (select *, row_number() over (partition by conv, sha256(text) order by turn) as same, row_number() over (partition by conv order by turn desc) as back from tn)
  select conv, sum(case when same > 1 or (tokens > 50 and back > 6) then 10 else tokens end)::bigint as after, sum(tokens)::bigint as before from k group by 1""")
def e9_optimise(spark, sf):
    """Tokens of each conversation before and after repeats and old long messages give way to a mark."""
    t = turns(spark, sf)
    same = F.row_number().over(Window.partitionBy("conv", F.sha2("text", 256)).orderBy("turn"))
    back = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("turn")))
    cut = (F.col("same") > 1) | ((F.col("tokens") > 50) & (F.col("back") > 6))
    return t.withColumn("same", same).withColumn("back", back).groupBy("conv").agg(F.sum(F.when(cut, 10).otherwise(F.col("tokens"))).alias("after"), F.sum("tokens").alias("before"))


@query(f"with {EVENT_SQL} select at // 86400 as day, event, count(*) as n from ev group by 1, 2")
def e5_stream_daily_counts(spark, sf):
    """Tumbling days from the stream; all states, as the table ends."""
    s = E.drain(E.daily_counts(E.read_events(spark, f"{sf}/events.parquet")), "daily", "complete")
    return s.select((F.unix_timestamp("day") / DAY).cast("long").alias("day"), "event", "n")


@query(f"with {EVENT_SQL} select node_id, event, at // 86400 as day from ev group by 1, 2, 3")
def e4_stream_daily_cap(spark, sf):
    s = E.drain(E.daily_first(E.read_events(spark, f"{sf}/events.parquet")), "cap")
    return s.select("node_id", "event", F.floor(F.unix_timestamp("ts") / DAY).alias("day"))


@query(_FOLD + " union all select node_id, 1.0 from ev group by 1 having bool_and(event = 'shown')")
def m13_stream_strength(spark, sf):
    return E.drain(E.strength(E.read_events(spark, f"{sf}/events.parquet")), "strength", "update")
