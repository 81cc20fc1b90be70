"""Usage ledgers: strength, verdicts, daily caps and co-activation.

Everything that depends on the order of events is a window or a fold over the
sorted events of one key; keys are nodes or pairs of nodes, never the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
# Days after which a memory's strength has halved; fixed values.
HALF_LIFE = {"gotcha": 180, "decision": 365, "insight": 120, "note": 90, "idea": 60}


def half_life() -> Column:
    out = F.when(F.col("kind") != "memory", F.lit(None))
    for k, d in HALF_LIFE.items():
        out = out.when(F.coalesce("subkind", F.lit("note")) == k, float(d))
    return out


def effective_strength(now: int) -> Column:
    """Strength halved per half-life since the last access; pinned and lasting kinds keep theirs."""
    age = F.greatest(F.lit(now) - F.coalesce("last_accessed", "created_at"), F.lit(0)) / float(DAY)
    h = half_life()
    return F.when(F.col("pinned") | h.isNull(), F.col("strength")).otherwise(F.col("strength") * F.pow(F.lit(2.0), -age / h))


def verdicts(events: DataFrame, gap: int) -> DataFrame:
    """Each 'opened' with the page last shown for its node; a page without a query still replaces the one before."""
    w = Window.partitionBy("node_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    page = F.last(F.when(F.col("event") == "shown", F.struct("query_hash", "at")), ignorenulls=True).over(w)
    v = events.withColumn("page", page).filter("event = 'opened' and page is not null")
    return v.select("id", "node_id", "at", F.col("page.query_hash").alias("query_hash"), (F.col("at") - F.col("page.at")).alias("gap")).filter(F.col("gap") <= gap)


def within_window(opened: DataFrame, span: int) -> DataFrame:
    """Pairs of opens of two nodes not more than ``span`` seconds apart, the later one first.

    A range join as an equi join: time is cut into slots of ``span``, and the
    earlier side enters its own slot and the next.
    """
    slot = F.floor(F.col("at") / span)
    later = opened.select("id", "node_id", "at", slot.alias("slot"))
    earlier = opened.select(F.col("node_id").alias("other"), F.col("at").alias("before"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    j = later.join(earlier, "slot")
    return j.filter((F.col("before") <= F.col("at")) & (F.col("before") >= F.col("at") - span) & (F.col("other") != F.col("node_id")))


def daily_first(events: DataFrame) -> DataFrame:
    day = F.floor(F.col("at") / DAY)
    w = Window.partitionBy("node_id", "event", "day").orderBy("at", "id")
    return events.withColumn("day", day).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def fold_strength(events: DataFrame, low: float = 0.05, high: float = 10.0) -> DataFrame:
    """node_id, strength: from 1, each day's first mark of a kind moves it, within its bounds."""
    step = F.when(F.col("event") == "opened", 0.3).when(F.col("event") == "useful", 1.0).otherwise(-1.0)
    first = daily_first(events.filter("event <> 'shown'")).select("node_id", F.struct("at", "id", step.alias("d")).alias("e"))
    per = first.groupBy("node_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    fold = F.aggregate("e", F.lit(1.0), lambda s, e: F.least(F.greatest(s + e["d"], F.lit(low)), F.lit(high)))
    return per.select("node_id", F.round(fold, 6).alias("strength"))


def pair_days(events: DataFrame, span: int = 1800) -> DataFrame:
    """src, dst, day: one fire per pair and day, with the time of the first."""
    opened = events.filter("event = 'opened'").select("id", "node_id", "at")
    p = within_window(opened, span).select(F.least("node_id", "other").alias("src"), F.greatest("node_id", "other").alias("dst"), "at")
    return p.groupBy("src", "dst", F.floor(F.col("at") / DAY).alias("day")).agg(F.min("at").alias("at"))


def co_activation(events: DataFrame, half: float = 30.0, rate: float = 0.15, cap: int = 32, span: int = 1800, blocks: int = 24) -> DataFrame:
    """Edges of nodes opened together: the weight decays between fires, then grows towards 1; a node keeps its strongest.

    Pairs are many more than opens, so they are never rows: a block of nodes gets the opens of all nodes around its own,
    packed by slots of ``span``, folds the fires of one node after the other and hands on what the node keeps.
    """
    opened = events.filter("event = 'opened' and node_id is not null and at is not null")
    opened = opened.select(F.col("node_id").cast("long").alias("node"), F.col("at").cast("long").alias("at"), F.floor(F.col("at") / span).alias("slot"))
    packed = opened.groupBy("slot").agg(F.collect_list((F.col("at") - F.col("slot") * span).cast("int")).alias("after"), F.collect_list("node").alias("node"))
    block = F.pmod(F.pmod("node", F.lit(_PRIME)), F.lit(blocks)).cast("int")
    own = opened.select(block.alias("block"), "slot").distinct()
    own = own.select("block", F.explode(F.array(F.col("slot") - 1, "slot", F.col("slot") + 1)).alias("slot")).distinct()
    # a partition is a block, whatever the planner would join together
    by_block = own.join(packed, "slot").repartitionById(blocks, F.col("block"))
    kept = by_block.mapInArrow(_strongest(half, rate, cap, span, blocks), "src bigint, dst bigint, weight double, last_fired_at bigint")
    # an edge stays while both its nodes keep it
    both = kept.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("weight").alias("weight"), F.min("last_fired_at").alias("last_fired_at"))
    return both.filter("n = 2").drop("n")


#: Spreads nodes over blocks also where their ids have a stride.
_PRIME = 1_000_003
#: A node's place beside the weight in one number.
_LOW = 0xFFFFFFFF


def _strongest(half: float, rate: float, cap: int, span: int, blocks: int):
    """For the packed opens of a block: the ``cap`` strongest edges of each of its nodes, of equal ones those to the largest ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        slots = [(b["block"], b["slot"], b["after"], b["node"]) for b in batches if b.num_rows]
        if not slots:
            return
        at = np.concatenate([np.repeat(s.to_numpy() * span, a.value_lengths().to_numpy()) + a.flatten().to_numpy() for _, s, a, _ in slots])
        node = np.concatenate([n.flatten().to_numpy() for *_, n in slots])
        block = slots[0][0][0].as_py()
        del slots
        order = np.argsort(at, kind="stable")
        at, (ids, who) = at[order], np.unique(node[order], return_inverse=True)
        # the opens of the block's nodes, one node after the other and in time
        mine = np.flatnonzero((ids % _PRIME % blocks == block)[who])
        mine = mine[np.argsort(who[mine], kind="stable")]
        t, d, me = at[mine], at[mine] // DAY, who[mine]
        follows = np.r_[False, me[1:] == me[:-1]]
        upto = np.searchsorted(at, t, "right")
        # what the open before has seen has fired on its day, and what is after the next open is left to that
        seen = follows & np.r_[False, (t[1:] - t[:-1] <= span) & (d[1:] == d[:-1])]
        first = np.where(seen, upto, np.searchsorted(at, t - span, "left"))
        last = np.searchsorted(at, t + span, "right")
        last = np.where(np.r_[follows[1:], False], np.minimum(last, np.r_[upto[1:], 0]), last)

        # a fire is one number: the other node's place, then the time of the later open
        zero, bits = int(at[0]), int(at[-1] - at[0]).bit_length()
        if bits + len(ids).bit_length() > 63:
            raise ValueError(f"{len(ids)} nodes and times from {at[0]} to {at[-1]} do not fit a number")
        place = who << bits
        theirs, t = place | (at - zero), (t - zero).tolist()
        starts = np.flatnonzero(~follows)
        sizes = np.add.reduceat(last - first, starts).tolist()
        first, upto, last, me = first.tolist(), upto.tolist(), last.tolist(), me.tolist()
        starts = [*starts.tolist(), len(me)]
        # room that is used again for each node
        row, room = np.arange(max(sizes)), [np.empty(max(sizes), kind) for kind in (np.int64, np.int64, np.int64, bool)]
        mark, again = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        once = int(np.floor(rate * 1e6 + 0.5))
        keys, times, kept = [], [], []

        def edges():
            k, n = np.concatenate(keys), np.repeat(kept, [len(x) for x in keys])
            ends = [ids[f(n, k & _LOW)] for f in (np.minimum, np.maximum)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*ends, (k >> 32) / 1e6, np.concatenate(times))], ["src", "dst", "weight", "last_fired_at"])

        for lo, hi, m in zip(starts, starts[1:], sizes):
            fires, met, found, twice = (x[:m] for x in room)
            np.concatenate([x for i in range(lo, hi) for x in (place[first[i] : upto[i]] | t[i], theirs[upto[i] : last[i]])], out=fires)
            np.concatenate([who[first[i] : last[i]] for i in range(lo, hi)], out=met)
            # most nodes are met once, and only the others are worth sorting
            mark[met] = row[:m]
            np.not_equal(mark.take(met, out=found, mode="clip"), row[:m], out=twice)
            repeated = met.compress(twice)
            again[repeated] = True
            more = again.take(met, out=twice, mode="clip")
            again[repeated] = False
            several = fires.compress(more)
            several.sort()
            other, now = several >> bits, (several & ((1 << bits) - 1)) + zero
            day = now // DAY
            # the first of a pair and day
            ahead = other[1:] == other[:-1]
            one = np.flatnonzero(np.r_[True, ~ahead | (day[1:] != day[:-1])][: len(other)])
            other, now = other[one], now[one]
            begin = np.flatnonzero(np.r_[True, other[1:] != other[:-1]][: len(other)])
            n = np.diff(begin, append=len(other))
            w, k, live = np.full(len(begin), rate), 1, np.flatnonzero(n > 1)
            while len(live):
                at_k = begin[live] + k
                x = w[live] * np.exp2((now[at_k - 1] - now[at_k]) / (half * DAY))
                w[live] = x + rate * (1 - x)
                k += 1
                live = live[n[live] > k]
            key, when = np.floor(w * 1e6 + 0.5).astype(np.int64) << 32 | other[begin], now[begin + n - 1]
            if np.count_nonzero(key >> 32 > once) <= cap:  # one may be the node itself
                # those met once are all as strong: the last in order are enough
                rest = fires[~more]
                if len(rest) > cap + 1:
                    rest = np.partition(rest, len(rest) - cap - 1)[len(rest) - cap - 1 :]
                key, when = np.r_[key, once << 32 | rest >> bits], np.r_[when, (rest & ((1 << bits) - 1)) + zero]
            stays = np.flatnonzero(key & _LOW != me[lo])
            if len(stays) > cap:
                stays = stays[np.argpartition(key[stays], len(stays) - cap)[len(stays) - cap :]]
            key, when = key[stays], when[stays]
            keys.append(key)
            times.append(when)
            kept.append(me[lo])
            if len(kept) == 4096:
                yield edges()
                keys, times, kept = [], [], []
        if kept:
            yield edges()

    return run


def deduplicate_stream(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """The same daily cap on a stream: needs a timestamp column ``ts``."""
    day = F.date_trunc("day", "ts")
    return events.withColumn("day", day).withWatermark("ts", late).dropDuplicates(["node_id", "event", "day"])
