"""Mixing sources to target weights.

The documents of a source are packed end to end into blocks of a fixed number of
tokens. The mix is a sequence of slots, one per block, divided into output
shards. Each shard draws how many of its slots go to each source from a
multinomial, and what the draws miss of the planned numbers is moved between
sources afterwards; the running number of a slot within its source then goes through a
pseudorandom permutation of that source's block numbers, a fresh one for each
round through the source, and slots meet blocks by a join on the number. No
block is drawn more often than max_repeats, so no token and no document is.

A source that cannot fill its share gives all it may; the rest of the mix goes
to the others in proportion to their shares, so the mix keeps its size as long
as any source has room. The report states the shares reached.

Packing needs a running sum per source. It is taken over range partitions of
(source, document), whose totals are summed up first, so a source with a third
of all documents is spread over many tasks.

The driver sees one row per mix and source only, a number fixed by mix_target.

Defined cases: null and empty texts have no tokens and never appear; a source
without documents is reported with nothing drawn; a null source belongs to no
mix; repeated rows of mix_target count once; an empty corpus gives a report of
zeros; a mix whose shares do not sum to 1 is scaled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.tokenize import BYTE_BPE, count_tokens
from stratalog.session import Scratch
from stratalog.tables import load

BLOCK_TOKENS, SHARD_BLOCKS, SEED = 256, 1024, 7
#: mix_target must stay this small, for its rows are planned on the driver.
MAX_TARGETS = 100_000


def packed(scratch: Scratch, sized: DataFrame, block_tokens: int) -> DataFrame:
    """``sized``: doc_id, source, tokens. Returns source, block, doc_id, tok_from, tok_to."""
    d = sized.filter("tokens > 0 and source is not null")
    d = scratch.keep(d.repartitionByRange("source", "doc_id").withColumn("part", F.spark_partition_id()), "ranged")
    sums = d.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    base = sums.select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(base, ["source", "part"]).withColumn("end", F.col("base") + F.sum("tokens").over(inside))
    d = d.withColumn("start", F.col("end") - F.col("tokens"))
    size = F.lit(block_tokens)
    first, last = F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)
    d = d.withColumn("block", F.explode(F.sequence(first, last)))
    return d.select(
        "source", "block", "doc_id",
        (F.greatest(F.col("start"), F.col("block") * size) - F.col("start")).alias("tok_from"),
        (F.least(F.col("end"), (F.col("block") + 1) * size) - F.col("start")).alias("tok_to"),
    )


def plan(targets: list[dict]) -> list[dict]:
    """Adds to each row of one mix its wanted number of slots: shares of the whole, never above the cap."""
    size = sum(t["blocks"] for t in targets)
    open_ = [t for t in targets if t["blocks"] and t["target_share"] > 0]
    for t in targets:
        t["cap"] = t["blocks"] * max(0, t["max_repeats"] or 0)
        t["slots"] = 0.0
    left = float(size)
    while open_ and left > 1e-9:
        whole = sum(t["target_share"] for t in open_)
        full = [t for t in open_ if left * t["target_share"] / whole >= t["cap"]]
        if not full:
            for t in open_:
                t["slots"] = left * t["target_share"] / whole
            break
        for t in full:
            t["slots"] = float(t["cap"])
            left -= t["cap"]
        open_ = [t for t in open_ if t not in full]
    for t in targets:
        t["want"] = int(t["slots"] + 1e-9)
    missing = round(sum(t["slots"] for t in targets)) - sum(t["want"] for t in targets)
    for t in sorted(targets, key=lambda t: t["want"] - t["slots"])[: max(0, missing)]:
        t["want"] += 1
    return targets


def _seed(*parts) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: a Feistel network walked until it falls below n."""
    bits = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = i.astype(np.uint64)
    todo = np.ones(len(out), bool)
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    while todo.any():
        x, b, m, k = out[todo], bits[todo], mask[todo], key[todo]
        left, right = x >> b, x & m
        for r in range(4):
            with np.errstate(over="ignore"):
                h = (right + k + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(32)
            left, right = right, (left ^ h) & m
        out[todo] = (left << b) | right
        todo = out >= n
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(i: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute(i.to_numpy(), n.to_numpy(), key.to_numpy()))


def draw(spark, sf_dir: str, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, path: str = BYTE_BPE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The slots of all mixes with their blocks, the blocks, and the targets."""
    s = Scratch(spark, "mix")
    targets = load(spark, sf_dir, "mix_target").distinct().groupBy("mix", "source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    docs = load(spark, sf_dir, "documents").join(targets.select("source").distinct(), "source", "left_semi")
    # written first: placing rows by range reads its input twice
    sized = s.keep(count_tokens(docs, ["doc_id", "source"], path=path), "sized")
    blocks = s.keep(packed(s, sized, block_tokens), "blocks")
    have = blocks.groupBy("source").agg((F.max("block") + 1).alias("blocks"))
    rows = [r.asDict() for r in targets.join(have, "source", "left").limit(MAX_TARGETS + 1).collect()]
    if len(rows) > MAX_TARGETS:
        raise ValueError("mix_target has too many rows")
    mixes: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["mix"] or "", r["source"] or "")):
        mixes.setdefault(r["mix"], []).append(r | {"blocks": r["blocks"] or 0, "target_share": max(0.0, r["target_share"] or 0.0)})
    plans = {m: plan(t) for m, t in mixes.items()}

    # how many slots of each shard go to each source
    shards = None
    for m, t in plans.items():
        total = sum(x["want"] for x in t)
        if not total:
            continue
        names, p = [x["source"] for x in t], np.array([x["want"] for x in t], float)

        def run(frames, m=m, names=names, p=p / p.sum(), total=total):
            for f in frames:
                for shard in f["id"]:
                    n = min(shard_blocks, total - shard * shard_blocks)
                    got = np.random.default_rng([seed, _seed(m), int(shard)]).multinomial(n, p)
                    yield pd.DataFrame({"mix": m, "shard": shard, "source": names, "n": got})

        part = spark.range(-(-total // shard_blocks)).mapInPandas(run, "mix string, shard long, source string, n long")
        shards = part if shards is None else shards.unionByName(part)
    slot_cols = "mix string, shard long, source string, round long, block long"
    if shards is None:
        return spark.createDataFrame([], slot_cols), blocks, targets.join(have, "source", "left")
    shards = s.keep(shards, "shards")
    drawn = {(r["mix"], r["source"]): r["n"] for r in shards.groupBy("mix", "source").agg(F.sum("n").alias("n")).collect()}

    # draws above the wanted number move to the sources that fell short of theirs
    moves, sizes = [("", "", 0, 0, "", 0)], []
    for m, t in plans.items():
        room = sorted(t, key=lambda x: -(x["slots"]))
        free = {x["source"]: x["want"] - drawn.get((m, x["source"]), 0) for x in t}
        end = {x["source"]: drawn.get((m, x["source"]), 0) for x in t}
        for x in t:
            sizes += [(m, x["source"], x["blocks"], _seed(seed, m, x["source"]))]
            i, over = x["want"], -free[x["source"]]
            while over > 0:
                to = next((y["source"] for y in room if free[y["source"]] > 0), None)
                if to is None:
                    break
                k = min(over, free[to])
                moves.append((m, x["source"], i, i + k, to, end[to]))
                i, over = i + k, over - k
                free[to] -= k
                end[to] += k
    moves = F.broadcast(spark.createDataFrame(moves, "mix string, source string, i_from long, i_to long, to string, j_from long"))
    sizes = F.broadcast(spark.createDataFrame(sizes, "mix string, source string, blocks long, key long"))
    caps = F.broadcast(spark.createDataFrame([(m, x["source"], x["want"]) for m, t in plans.items() for x in t], "mix string, source string, cap long"))

    w = Window.partitionBy("mix", "source").orderBy("shard")
    slots = shards.withColumn("start", F.sum("n").over(w) - F.col("n")).filter("n > 0")
    slots = slots.select("mix", "shard", "source", F.explode(F.expr("sequence(start, start + n - 1)")).alias("i"))
    a, b = slots.alias("a"), moves.alias("b")
    slots = (
        a.join(b, F.expr("a.mix = b.mix and a.source = b.source and a.i >= b.i_from and a.i < b.i_to"), "left")
        .join(caps.alias("c"), F.expr("a.mix = c.mix and a.source = c.source"))
        .filter("a.i < c.cap or b.to is not null")
        .select("a.mix", "a.shard", F.expr("coalesce(b.to, a.source)").alias("source"), F.expr("if(b.to is null, a.i, b.j_from + a.i - b.i_from)").alias("i"))
        .join(sizes, ["mix", "source"])
    )
    turn, at = F.floor(F.col("i") / F.col("blocks")), F.col("i") % F.col("blocks")
    slots = slots.select("mix", "shard", "source", turn.alias("round"), _permuted(at, "blocks", F.col("key") + turn * 7919).alias("block"))
    return s.keep(slots, "slots"), blocks, targets.join(have, "source", "left")


def p9_mix(spark, sf_dir: str) -> DataFrame:
    """The mixes: which tokens of which documents stand in each drawn block."""
    slots, blocks, _ = draw(spark, sf_dir)
    return slots.join(blocks, ["source", "block"]).select("mix", "shard", "source", "round", "block", "doc_id", "tok_from", "tok_to")


def p9_shares(spark, sf_dir: str) -> DataFrame:
    """Target and reached shares of tokens per mix and source, and how often a block was used at most."""
    slots, blocks, targets = draw(spark, sf_dir)
    used = slots.groupBy("mix", "source", "block").agg(F.count("*").alias("uses"))
    sized = blocks.groupBy("source", "block").agg(F.sum(F.col("tok_to") - F.col("tok_from")).alias("tokens"))
    got = used.join(sized, ["source", "block"]).groupBy("mix", "source").agg(
        F.sum(F.col("uses") * F.col("tokens")).alias("drawn_tokens"), F.max("uses").alias("most_uses")
    )
    have = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    out = targets.join(got, ["mix", "source"], "left").join(have, "source", "left")
    drawn = F.coalesce("drawn_tokens", F.lit(0))
    whole = F.sum(drawn).over(Window.partitionBy("mix"))
    return out.select(
        "mix", "source", "target_share", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        drawn.alias("drawn_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.when(whole > 0, drawn / whole).otherwise(F.lit(0.0)).alias("actual_share"),
    )
