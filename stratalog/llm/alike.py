"""Near-duplicate records with small edits.

Two records are alike when the words in both are at least four fifths of the words
in at least one of them, that is of their union; records tied together by likeness
form a group. The join is exact.

Prefix-tree join. The words of a record are ordered from the rarest to the most
frequent. A record of n words may miss m = n - ceil(0.8 n) of them, so its first
m + k words hold at least k of those in common with any record alike. These
prefixes form a tree, and the part of it that hangs on one word is a tree of its
own: the rest of the prefix of every record that has this word among its first
m + 1. Such trees are independent of each other, so they are what is shuffled, by
word. A tree is walked breadth first with all partners at a time. A node stands
for all records below it and holds the partners that met enough of the path to
it: the words met on a path are counted once for the whole subtree, and a partner
falls out as soon as it missed more words than the longest allowance below leaves.
What reaches the end of a path is a candidate. Candidates are compared by bit
sketches, whose differences the sets must have too, and those left word for word
by 64-bit hashes, the only thing that stands for a word here.

The order comes from counts over all records in 2^22 buckets of word hashes, a
table of fixed size; inside a bucket the hash decides. In a tree words are written
as 16-bit numbers that keep the order, so two words may look the same; they then
count as met, which makes a candidate more and never a link less. Words behind the
last one of a partner's prefix are unknown and count neither way. At most ``REST``
words of a prefix follow a tree's word, so that very long records stay linear;
beyond them nothing is pruned.

A word that more than ``HEAVY`` prefixes have is split into a grid of blocks, each
a tree of its own in another task. Records of the same words are one class and
take part once, so a group of exact copies, however large, costs one row.

Defined cases: null or blank bodies, other kinds and records of fewer than
``least`` words take no part; a null title counts as empty; repeated ids count
once; an empty table gives no rows; columns beyond those named are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.components import components
from stratalog.session import Scratch
from stratalog.tables import load

KINDS = ("memory", "chunk", "annotation")
#: The share of the words of two records that both have, as a fraction of whole numbers.
(P, Q), LEAST = (4, 5), 10
#: Words in common that two alike prefixes have at least.
MET = 3
#: Bits of a hash that name its bucket, and those kept of the rest.
BUCKET_BITS, LOW_BITS = 22, 22
#: Prefixes of a block of one word's tree.
HEAVY = 4096
#: Words of a prefix that follow a tree's word.
REST = 256
#: Words of a tree's edge: a tree has one level for each so many words.
EDGE = 4
#: Words of 64 bits of a sketch.
SKETCH = 8
#: The class copies are sent to all tasks only up to this number of bytes.
COPIES_BYTES = 8 << 20
#: Rows whose trees are built at a time, and entries walked at a time.
ROWS, ENTRIES = 200_000, 1_000_000
#: Members of a group are paired in blocks of this many.
PAIR_BLOCK = 1024
#: Pairs that one task writes, about.
PAIRS_A_TASK = 4_000_000

_runs = re.compile(r"[^\W_]+").findall


def words_of(title: str | None, body: str) -> set[str]:
    text = f"{title} {body}" if title else body
    if text.isascii():
        return set(_runs(text.lower()))
    return {w.lower() for w in _runs(text)}


class _Hashes(dict):
    """64-bit hash of a word, kept while the worker lives; bounded in size."""

    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 500_000:
            self[word] = h
        return h


_hashes = _Hashes()


def _sets(least: int):
    def run(batches):
        for b in batches:
            ids, sizes, hashes = [], [], []
            for i, title, body in zip(*(b.column(n).to_pylist() for n in ("id", "title", "body"))):
                if not body or not body.strip():
                    continue
                w = words_of(title, body)
                if len(w) >= least:
                    ids.append(i)
                    sizes.append(len(w))
                    hashes.append(np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w)))
            off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            # two sums of a set's hashes tell equal sets
            k1, k2 = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
            if len(ids):
                k1, k2 = np.add.reduceat(flat, off[:-1]), np.add.reduceat(flat * (flat >> np.uint64(7)), off[:-1])
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sizes, pa.int32()), lists], ["id", "k1", "k2", "n", "toks"]
            )

    return run


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one after the other."""
    if not len(n):
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(start - (ends - n), n)


def _flat(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(name)
    off = lists.offsets.to_numpy().astype(np.int64)
    return off - off[0], lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]


class WordOrder:
    """The order of words from the rarest bucket to the most frequent, by hash inside a bucket."""

    def __init__(self, counts: np.ndarray):
        used = np.flatnonzero(counts)
        used = used[np.argsort(counts[used], kind="stable")]
        self.rank = np.zeros(len(counts), np.uint32)
        self.rank[used] = np.arange(len(used), dtype=np.uint32)
        # 16-bit numbers that keep the order, finer where words are met more often
        weight = np.cumsum(np.sqrt(counts[used]))
        self.band = (1 + weight * 65_534 / weight[-1]).astype(np.uint16) if len(used) else np.zeros(0, np.uint16)

    def sort(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Codes of each row's words in ascending order: the rank of the bucket, then bits of the hash."""
        h = h.view(np.uint64)
        code = (self.rank[(h >> np.uint64(64 - BUCKET_BITS)).view(np.int64)].astype(np.uint64) << np.uint64(LOW_BITS)) | (
            (h >> np.uint64(64 - BUCKET_BITS - LOW_BITS)) & np.uint64((1 << LOW_BITS) - 1)
        )
        key = np.repeat(np.arange(len(off) - 1, dtype=np.uint64) << np.uint64(BUCKET_BITS + LOW_BITS), np.diff(off)) | code
        key.sort()
        return key & np.uint64((1 << (BUCKET_BITS + LOW_BITS)) - 1)


def _parts(batches, rows: int = 1 << 18):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _tally(keys):
    """Counts of the numbers below 2^22 that ``keys`` gives for a batch, and of a part of them; one table a task."""

    def run(batches):
        sums = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for b in _parts(batches):
            for s, k in zip(sums, keys(b)):
                s += np.bincount(k, minlength=len(s))
        hit = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), *map(pa.array, sums[:, hit])], ["k", "n", "part"])

    return run


def _table(df: DataFrame, keys) -> np.ndarray:
    """The counts over all tasks: 2^22 numbers at most, whatever the size of the input."""
    got = df.select("toks").mapInArrow(_tally(keys), "k int, n bigint, part bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("part").alias("part")).toArrow()
    out = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    out[:, got["k"].to_numpy()] = got["n"].to_numpy(), got["part"].to_numpy()
    return out


def _buckets(batch) -> list[np.ndarray]:
    return [(_flat(batch, "toks")[1].view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).view(np.int64)]


def _misses(n: np.ndarray) -> np.ndarray:
    """Words of a record that a record alike may lack."""
    return n - -(-n * P // Q)


def _leads(n: np.ndarray) -> np.ndarray:
    """Words of a record that one alike and no smaller may lack."""
    return n * (Q - P) // (P + Q)


def _prefix_ranks(order):
    """Ranks of the words of the prefixes, and of those that a record can share first with a larger one."""

    def run(batch) -> list[np.ndarray]:
        off, h = _flat(batch, "toks")
        rank = (order.value.sort(h, off) >> np.uint64(LOW_BITS)).view(np.int64)
        n = np.diff(off)
        return [rank[_spans(off[:-1], f(n) + 1)] for f in (_misses, _leads)]

    return run


def _branches(order, tally):
    """One row per record and word that may be the first of those in common with another record."""

    def run(batches):
        for b in _parts(batches, 1 << 13):
            off, h = _flat(b, "toks")
            code = order.value.sort(h, off)
            n = np.diff(off)
            m = _misses(n)
            row = np.repeat(np.arange(len(n)), m + 1)
            at = _spans(off[:-1], m + 1)
            rank = (code[at] >> np.uint64(LOW_BITS)).view(np.int64)
            meets, leads = tally.value[:, rank]
            # of two records alike the smaller one has their first common word among its leads
            own = at - off[row] <= _leads(n)[row]
            keep = np.flatnonzero((meets > 1) & (own | (leads > 0)))
            row, at, meets = row[keep], at[keep], meets[keep]
            ids = b.column("id").to_numpy(zero_copy_only=False)
            # blocks of a heavy word: a record goes to every cell of its row and column
            blocks = -(-meets // HEAVY)
            own = ((ids[row] * 2654435761) >> 9) % blocks
            other = _spans(np.zeros(len(blocks), np.int64), blocks)
            row, at, own, blocks = (np.repeat(v, blocks) for v in (row, at, own, blocks))
            cell = np.minimum(own, other) * blocks + np.maximum(own, other)
            pos = at - off[row]
            size = np.minimum(m[row] + MET - pos - 1, REST)
            rest = order.value.band[(code[_spans(at + 1, size)] >> np.uint64(LOW_BITS)).view(np.int64)]
            ends = np.concatenate([[0], 2 * np.cumsum(size)]).astype(np.int32)
            rests = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rest.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[at].view(np.int64)), pa.array(cell), pa.array(n[row].astype(np.int32)), pa.array(ids[row]), pa.array(pos.astype(np.int32)), rests],
                ["word", "cell", "n", "id", "pos", "rest"],
            )

    return run


class _Level:
    """The nodes of all trees at one depth, ordered by their parents."""

    def __init__(self, rows, parent, edge, parents: int, n, best, ends):
        order = np.lexsort((edge, parent))
        rows, parent, edge = rows[order], parent[order], edge[order]
        new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (edge[1:] != edge[:-1])])
        at = np.flatnonzero(new)
        self.edge = edge[at].reshape(-1, 1).view(np.uint16)
        # of the records below a node: the longest allowance, the least size, the first row
        self.best = np.maximum.reduceat(best[rows], at)
        self.least = np.minimum.reduceat(n[rows], at)
        self.first = np.minimum.reduceat(rows, at)
        self.parent = parent[at]
        self.children = np.searchsorted(self.parent, np.arange(parents + 1))
        node = np.cumsum(new) - 1
        end = ends[rows]
        self.ending, of = rows[end], node[end]
        self.ended = np.searchsorted(of, np.arange(len(at) + 1))
        self.rows, self.node = rows[~end], node[~end]

    def __len__(self) -> int:
        return len(self.best)


def candidates(group: np.ndarray, ids: np.ndarray, n: np.ndarray, pos: np.ndarray, off: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that may be alike, from the trees of whole groups.

    Rows are ordered by group, size and id; ``group`` counts from 0, ``flat`` holds
    the rests of the prefixes between the bounds ``off``.
    """
    n, pos, size = n.astype(np.int64), pos.astype(np.int64), np.diff(off)
    cut = size < _misses(n) + MET - pos - 1
    last = flat[off[1:] - 1]
    best = Q * n - (P + Q) * pos
    depth = -(-size // EDGE)
    edges = np.zeros(EDGE * depth.sum(), np.uint16)
    start = np.cumsum(depth) - depth
    edges[_spans(EDGE * start, size)] = flat
    edges = edges.view(np.uint64)
    rows = np.arange(len(n))
    levels, parent, parents = [], group.astype(np.int64), int(group[-1]) + 1
    while len(rows):
        k = len(levels)
        levels.append(_Level(rows, parent, edges[start[rows] + k], parents, n, best, depth == k + 1))
        rows, parent, parents = levels[-1].rows, levels[-1].node, len(levels[-1])
    member = (np.repeat(np.arange(len(n), dtype=np.int64), size) << 16) | flat
    member.sort()
    # a node's partners come behind its first row and are not too large
    top = levels[0]
    order = (top.parent << 40) + np.minimum(top.best, (1 << 40) - 1)
    stop = np.searchsorted((group.astype(np.int64) << 40) + P * n, order, "right")
    many = np.maximum(stop - top.first - 1, 0)
    found = []
    done = np.cumsum(many)
    a = 0
    while a < len(many):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + ENTRIES, "right")))
        found.append(_walk(levels, np.repeat(np.arange(a, b), many[a:b]), _spans(top.first[a:b] + 1, many[a:b]), n, pos, best, last, cut, member))
        a = b
    x, y = (np.concatenate(v) for v in zip(*found))
    x, y = ids[x], ids[y]
    return np.minimum(x, y), np.maximum(x, y)


def _walk(levels, node, y, n, pos, best, last, cut, member):
    """The pairs of rows that come to the end of a path, from pairs of a first node and a partner."""
    keep = best[y] >= P * levels[0].least[node]
    node, y = node[keep], y[keep]
    missed, met = np.zeros(len(y), np.int64), np.ones(len(y), np.int64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k, level in enumerate(levels):
        if not len(y):
            break
        words = level.edge[node]
        key = (y << 16)[:, None] | words
        hit = member[np.minimum(np.searchsorted(member, key.ravel()), len(member) - 1)].reshape(key.shape) == key
        met = met + hit.sum(1)
        missed = missed + (~hit & (words < last[y][:, None]) & (words > 0)).sum(1)
        keep = (P + Q) * missed <= level.best[node] - P * n[y]
        node, y, missed, met = node[keep], y[keep], missed[keep], met[keep]
        # records that end here
        many = level.ended[node + 1] - level.ended[node]
        x = level.ending[_spans(level.ended[node], many)]
        y_, missed_, met_ = np.repeat(y, many), np.repeat(missed, many), np.repeat(met, many)
        good = (x < y_) & ((P + Q) * missed_ <= best[x] - P * n[y_]) & (best[y_] >= P * n[x]) & ((met_ >= MET) | cut[x] | cut[y_])
        out.append((x[good], y_[good]))
        if k + 1 < len(levels):
            many = levels[k + 1].children[node + 1] - levels[k + 1].children[node]
            node = _spans(levels[k + 1].children[node], many)
            y, missed, met = np.repeat(y, many), np.repeat(missed, many), np.repeat(met, many)
    return tuple(np.concatenate(v) for v in zip(*out))


def _trees(batches):
    """Candidates of a partition whose rows are ordered by tree, size and id."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(t: pa.Table):
        word, cell = t["word"].to_numpy(), t["cell"].to_numpy()
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (cell[1:] != cell[:-1])])
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        t = t.filter(pa.array(np.repeat(size > 1, size))).combine_chunks()
        if not t.num_rows:
            return
        rest = t["rest"].chunk(0)
        off = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + len(rest) + 1].astype(np.int64) // 2
        flat = np.frombuffer(rest.buffers()[2], np.uint16)[off[0] : off[-1]]
        group = np.repeat(np.arange(np.count_nonzero(size > 1)), size[size > 1])
        a, b = candidates(group, *(t[k].to_numpy() for k in ("id", "n", "pos")), off - off[0], flat)
        got = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], schema=schema)

    held: list = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) < ROWS:
            continue
        t = pa.Table.from_batches(held)
        word, cell = t["word"].to_numpy(), t["cell"].to_numpy()
        whole = len(word) - int(np.argmax(((word != word[-1]) | (cell != cell[-1]))[::-1])) if (word[0], cell[0]) != (word[-1], cell[-1]) else 0
        if whole:
            yield from pairs(t.slice(0, whole))
            held = t.slice(whole).to_batches()
    if held:
        yield from pairs(pa.Table.from_batches(held))


def similarity_links(nodes: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(members: id and its class's representative, links between representatives)."""
    sc = nodes.sparkSession.sparkContext
    rows = nodes.filter(F.col("kind").isin(*KINDS) & F.col("body").isNotNull()).select("id", "title", "body")
    # a word takes a character and a blank; one blank joins title and body
    rows = rows.filter(F.length("body") + F.coalesce(F.length("title") + 1, F.lit(0)) >= 2 * least - 1)
    sets = scratch.keep(rows.mapInArrow(_sets(least), "id bigint, k1 bigint, k2 bigint, n int, toks array<bigint>"), "sets")
    members = _members(sets, scratch)
    copies = members.filter("id <> rep").select("id")
    if 16 * copies.count() <= COPIES_BYTES:
        copies = F.broadcast(copies)
    # a repeated row of the table is a repeated id: one of its sets is enough
    reps = sets.join(copies, "id", "left_anti").select("id", "n", "toks")
    order = sc.broadcast(WordOrder(_table(reps, _buckets)[0]))
    tally = sc.broadcast(_table(reps, _prefix_ranks(order)).astype(np.int32))
    branches = reps.mapInArrow(_branches(order, tally), "word bigint, cell bigint, n int, id bigint, pos int, rest binary")
    trees = branches.repartition("word", "cell").sortWithinPartitions("word", "cell", "n", "id")
    pairs = scratch.keep(trees.mapInArrow(_trees, "a bigint, b bigint").distinct(), "pairs")
    near = scratch.keep(_near(pairs, reps, scratch), "near")
    of = _only(reps, near)
    side = lambda k: of.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("toks").alias(f"toks_{k}"))
    both = near.join(side("a"), "a").join(side("b"), "b")
    alike = (P + Q) * F.size(F.array_intersect("toks_a", "toks_b")) >= P * (F.col("n_a") + F.col("n_b"))
    return members, scratch.keep(both.filter(alike).select("a", "b").distinct(), "links")


def _only(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    return reps.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")


def _sketches(batches):
    """Bits that each word of a set turns over: two sets differ in at least as many words as their sketches in bits."""
    for b in batches:
        off, h = _flat(b, "toks")
        row = np.repeat(np.arange(b.num_rows), np.diff(off))
        odd = np.bincount(row * 64 * SKETCH + (h.view(np.uint64) % np.uint64(64 * SKETCH)).view(np.int64), minlength=b.num_rows * 64 * SKETCH) & 1
        bits = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, SKETCH)
        cols = [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), *cols], ["id", "n", *(f"s{k}" for k in range(SKETCH))])


def _near(pairs: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs that sketches do not tell apart."""
    names = [f"s{k}" for k in range(SKETCH)]
    made = _only(reps, pairs).mapInArrow(_sketches, ", ".join(["id bigint", "n int", *(f"{s} bigint" for s in names)]))
    made = scratch.keep(made, "sketches")
    side = lambda k: made.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ["n", *names]))
    differ = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in names), F.lit(0))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter((P + Q) * differ <= (Q - P) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _members(sets: DataFrame, scratch: Scratch) -> DataFrame:
    key = ["k1", "k2", "n"]
    reps = sets.groupBy(*key).agg(F.min("id").alias("rep"))
    return scratch.keep(sets.select("id", *key).join(reps, key).select("id", "rep").distinct(), "members")


def groups(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership: id, rep, grp; links between representatives; scratch members)."""
    spark = nodes.sparkSession
    scratch = Scratch(spark, "alike")
    members, links = similarity_links(nodes, scratch)
    comp = components(spark, links)
    out = members.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return scratch.keep(out.select("id", "rep", F.coalesce("component", "rep").alias("grp")), "groups"), links, members


def pairs_of_groups(member: DataFrame) -> DataFrame:
    """All pairs of ids of a group. Large groups are paired block by block over many tasks."""
    size = member.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1")
    total = size.agg(F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()[0] or 0
    m = member.select("id", "grp").join(size, "grp")
    own = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / PAIR_BLOCK)).cast("int")
    blocks = m.groupBy("grp", own.alias("i")).agg(F.collect_list("id").alias("a"))
    other = blocks.select("grp", F.col("i").alias("j"), F.col("a").alias("b"))
    both = blocks.join(other, "grp").filter("i <= j")
    # a fixed number, since few bytes of blocks make many rows
    both = both.repartition(max(1, min(10_000, int(total // PAIRS_A_TASK) + 1)), "grp", "i", "j")
    return both.select("a", "b", (F.col("i") == F.col("j")).alias("same")).mapInArrow(_pairs, "node_a bigint, node_b bigint")


def _pairs(batches):
    """The pairs of two blocks, the smaller id first, in ascending runs."""
    schema = pa.schema([("node_a", pa.int64()), ("node_b", pa.int64())])
    for batch in batches:
        for a, b, same in zip(batch.column("a"), batch.column("b"), batch.column("same").to_pylist()):
            a, b = np.sort(a.values.to_numpy()), np.sort(b.values.to_numpy())
            for x, y in ((a, b),) if same else ((a, b), (b, a)):
                first = np.searchsorted(y, x, "right")
                n = len(y) - first
                ends = np.cumsum(n)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n)), pa.array(y[at])], schema=schema)


def p7_found(spark, sf_dir: str) -> DataFrame:
    member, _, _ = groups(load(spark, sf_dir, "node"))
    return pairs_of_groups(member)


def p7_groups(spark, sf_dir: str) -> DataFrame:
    """One row per node: the class of equal words, the group, and the links its class has to others."""
    member, links, _ = groups(load(spark, sf_dir, "node"))
    ends = links.select(F.col("a").alias("rep")).unionAll(links.select("b"))
    per = ends.groupBy("rep").agg(F.count("*").alias("links"))
    return member.join(per, "rep", "left").select(F.col("id").alias("node_id"), F.col("rep").alias("class_id"), F.col("grp").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
