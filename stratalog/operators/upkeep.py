"""Small operators around the store: cadences, coverage, gaps, naming, guards, annotations, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import predicates as P

DAY = 86_400


def due(last, now: int, cadence: str = "weekly") -> Column:
    """Whether the weekly upkeep should run: never before, or seven days ago; other cadences never."""
    last = F.col(last) if isinstance(last, str) else last
    return F.lit(cadence == "weekly") & (F.lit(now) - F.coalesce(last, F.lit(0)) >= 7 * DAY)


def covered(edges: DataFrame, members: DataFrame, sources: DataFrame) -> DataFrame:
    """grp, members, covered, done of groups (grp, id): done when summaries by live ``sources`` (id) reach half of the members or more."""
    e = edges.filter("rel = 'summarizes'").join(sources.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    m = members.join(e.withColumn("hit", F.lit(1)), "id", "left").groupBy("grp").agg(F.count("*").alias("members"), F.count("hit").alias("covered"))
    return m.withColumn("done", F.col("covered") * 2 >= F.col("members"))


def uncovered(spans: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """Runs of whole numbers of each key within 1 to ``last`` (``bounds``: key, last) that no span (key, first, end) covers.

    One window over the spans of a key; no line is ever a row. Spans with a null
    or wrong end are ignored, and what sticks out of the bounds is cut off.
    """
    s = spans.join(bounds, key).filter("first is not null and end >= first and end >= 1 and first <= last")
    s = s.select(key, F.greatest("first", F.lit(1)).cast("long").alias("first"), F.least("end", "last").cast("long").alias("end"))
    ends = bounds.select(key, (F.col("last") + 1).cast("long").alias("first"), (F.col("last") + 1).cast("long").alias("end"))
    w = Window.partitionBy(key).orderBy("first", "end")
    gap = s.unionByName(ends).withColumn("seen", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return gap.filter("first > seen + 1").select(key, (F.col("seen") + 1).alias("run_first"), (F.col("first") - 1).alias("run_last"))


def link_targets(refs: DataFrame, nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``refs``: ref. The node of a reference by id, else the only symbol (id, name) of that name; status tells which, or 'ambiguous', 'none'."""
    ids = nodes.select(F.col("id").cast("string").alias("ref"), F.col("id").alias("by_id")).distinct()
    names = symbols.groupBy(F.col("name").alias("ref")).agg(F.countDistinct("id").alias("n"), F.min("id").alias("by_name"))
    j = refs.join(ids, "ref", "left").join(names, "ref", "left")
    status = F.when(F.col("by_id").isNotNull(), "id").when(F.col("n") == 1, "symbol").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return j.select("ref", F.coalesce("by_id", F.when(F.col("n") == 1, F.col("by_name"))).alias("id"), status.alias("status"))


def newest_tagged(nodes: DataFrame, project: int | None, tag: str = "session-handoff") -> DataFrame:
    """The newest live memory of a tag in scope: id, body; what a new session is handed."""
    n = nodes.filter(P.kinds("memory") & P.live() & P.tagged(tag) & P.scope(project))
    return n.orderBy(F.desc("created_at"), "id").limit(1).select("id", "body")


def primed(opened: DataFrame, edges: DataFrame, now: int, span: int = 1800) -> DataFrame:
    """Partners of what was opened in the last ``span`` seconds, with their strongest edge; the opened ones themselves are left out."""
    o = opened.filter((F.col("event") == "opened") & (F.col("at") <= now) & (F.col("at") > now - span)).select(F.col("node_id").alias("node")).distinct()
    e = edges.filter("rel = 'co_recalled'")
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("partner"), "weight").unionAll(e.select("dst", "src", "weight"))
    hit = both.join(o, "node", "left_semi").join(o.withColumnRenamed("node", "partner"), "partner", "left_anti")
    return hit.groupBy("partner").agg(F.max("weight").alias("weight"))


def rerank_wanted(mode: str, tokens: int, embeddable: int, loaded: bool = False) -> bool:
    """Queries of more than one token over a thousand embeddable nodes; 'warm' only with a scorer at hand."""
    return mode in ("warm", "always") and tokens > 1 and embeddable >= 1000 and (mode == "always" or loaded)


def rerank(scored: DataFrame, scorer: Column, limit: int = 8, over: int = 15) -> DataFrame:
    """The best of more hits than wanted, put in the order of another score; hits it gives none keep their order behind.

    ``scorer`` is any column over title and body; a model comes in as a Pandas UDF.
    """
    more = scored.orderBy(F.desc("score"), "id").limit(max(limit, over)).withColumn("again", scorer)
    return more.orderBy(F.col("again").desc_nulls_last(), F.desc("score"), "id").limit(limit)


def pair_text(most: int = 1500) -> Column:
    """Title and body as a scorer reads them."""
    return F.substring(F.concat(X.text_of("title"), F.lit("\n"), X.text_of("body")), 1, most)


def group_names(members: DataFrame) -> DataFrame:
    """grp, name of groups (grp, path, title): the most frequent folder and the three most frequent words; of equally frequent ones the smallest."""
    folder = F.when(F.col("path").isNotNull(), F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    dirs = members.select("grp", folder.alias("dir")).filter("dir is not null").groupBy("grp", "dir").agg(F.count("*").alias("n"))
    dirs = dirs.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "dir"))).filter("r = 1").select("grp", "dir")
    words = members.select("grp", F.explode(F.split(F.lower(X.text_of("title")), r"[^\p{L}\p{N}]+")).alias("t")).filter("length(t) > 2")
    top = words.groupBy("grp", "t").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "t"))).filter("r <= 3")
    theme = top.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("ts"))
    j = members.select("grp").distinct().join(dirs, "grp", "left").join(theme, "grp", "left")
    ts = F.coalesce("ts", F.array().cast("array<string>"))
    bare = F.coalesce("dir", F.lit("")) == ""
    return j.select("grp", F.when(bare, F.array_join(ts, "-")).otherwise(F.concat("dir", F.lit(" ("), F.array_join(ts, ", "), F.lit(")"))).alias("name"))


def duplicates_rules(body, rules: str) -> Column:
    """Whether the first 80 characters of a text stand in the rules, case and blanks apart."""
    head = F.trim(F.substring(F.lower(X.collapse_ws(body)), 1, 80))
    return (head != "") & F.contains(F.lit(" ".join(rules.split()).lower()), head)


def guard_message(pct, threshold: int, mode: str) -> Column:
    """What a session is told when its window fills; null below the threshold and in other modes."""
    pct = F.col(pct) if isinstance(pct, str) else pct
    how = {"pause": "Clear or compact it on purpose now; save a handoff first.", "handoff": "Write one handoff memory with what is in flight and the next step, then clear."}
    if mode not in how:
        return F.lit(None).cast("string")
    return F.when(pct >= threshold, F.concat(F.lit("context about "), pct.cast("int").cast("string"), F.lit("% full. " + how[mode])))


def guard_marks(events: DataFrame) -> DataFrame:
    """Per event (session, at, id, source, size) the marker in force after it: a startup clears it, a clear or compact
    sets it to the size, anything else leaves it."""
    w = Window.partitionBy("session").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("source") == "startup", F.struct(F.lit(None).cast("long").alias("m"))).when(F.col("source").isin("clear", "compact"), F.struct(F.col("size").cast("long").alias("m")))
    return events.withColumn("marker", F.last(mark, ignorenulls=True).over(w)["m"])


def annotate(targets: DataFrame, next_id: int, now: int) -> tuple[DataFrame, DataFrame]:
    """``targets``: id, kind, project_id, collection_id, text. Annotation nodes and their 'describes' edges; a note on a
    collection belongs to it, any other to the collection of its target."""
    t = targets.filter("text is not null")
    place = F.row_number().over(Window.orderBy("id")) - 1 + F.lit(next_id)  # few rows: one per note written
    t = t.withColumn("note", place.cast("long"))
    own = F.when(F.col("kind") == "collection", F.col("id")).otherwise(F.col("collection_id"))
    note = t.select(F.col("note").alias("id"), F.lit("annotation").alias("kind"), "project_id", own.alias("collection_id"), X.derive_title("text").alias("title"), F.col("text").alias("body"), F.lit(now).cast("long").alias("created_at"))
    edge = t.select(F.col("note").alias("src"), F.col("id").alias("dst"), F.lit("describes").alias("rel"), F.lit(1.0).alias("weight"), F.lit(now).cast("long").alias("created_at"))
    return note, edge


def touched(nodes: DataFrame, opened: DataFrame, now: int) -> DataFrame:
    """New versions of the nodes opened (node_id, at): counted and last accessed."""
    o = opened.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n"), F.max("at").alias("at"))
    hit = nodes.join(o, "id")
    return hit.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.col("n")).withColumn("last_accessed", F.greatest("last_accessed", "at")).withColumn("updated_at", F.lit(now).cast("long")).drop("n", "at")


def pinned(nodes: DataFrame, which: Column, value: bool, now: int) -> DataFrame:
    hit = nodes.filter(which & (F.coalesce("pinned", F.lit(False)) != F.lit(value)))
    return hit.withColumn("pinned", F.lit(value)).withColumn("updated_at", F.lit(now).cast("long"))


def moved(nodes: DataFrame, which: Column, project: int | None, now: int) -> DataFrame:
    """Memories, and only those, put into another project."""
    hit = nodes.filter(which & (F.col("kind") == "memory"))
    return hit.withColumn("project_id", F.lit(project).cast("long")).withColumn("updated_at", F.lit(now).cast("long"))


def cache_savings(responses: DataFrame, text: str = "text") -> DataFrame:
    """Tokens read from a cache as the responses (id, text) tell, and what they cost instead: a tenth."""
    n = F.regexp_extract(text, r'"cache_read_input_tokens"[: ]*(\d+)', 1).try_cast("long")
    return responses.select("id", n.alias("tokens_before")).filter("tokens_before > 0").withColumn("tokens_after", F.floor(F.col("tokens_before") / 10))


class Memo:
    """Vectors of recent queries; emptied when full."""

    def __init__(self, most: int = 256):
        self.most, self.held = most, {}

    def get(self, text: str, make: Callable[[str], list[float] | None]) -> list[float] | None:
        if text not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            v = make(text)
            if v is None:
                return None
            self.held[text] = v
        return self.held[text]


class Ladder:
    """Providers of vectors, tried in order; one that fails or answers wrongly rests, and without any recall goes on by words."""

    def __init__(self, providers: list[Callable[[str], list[float]]], dim: int, rest: float = 60.0):
        self.providers, self.dim, self.rest, self.until = providers, dim, rest, [0.0] * len(providers)

    def __call__(self, text: str, clock: float) -> list[float] | None:
        for k, p in enumerate(self.providers):
            if clock < self.until[k]:
                continue
            try:
                v = p(text)
            except PermissionError:
                self.until[k] = float("inf")  # refused for good
                continue
            except Exception:
                v = None
            if v is not None and len(v) == self.dim:
                return v
            self.until[k] = clock + self.rest
        return None
