"""Encoding a corpus with a public byte-level BPE tokenizer.

Corpus-level merge replay. A task takes its documents in blocks of bounded size,
cuts the texts into the tokenizer's words and keeps each distinct word once. An
inverted index leads from a pair of neighbouring tokens to the places where it
stands, over all words at once. The merges are then applied in the order of
their ranks: a merge visits only the places of its pair, and only the two
neighbours of a place change their pairs. Merges never cross a word, so the
result of a word does not depend on the block it is in.

The vocabulary file is a parameter; each Python worker reads it once.

Defined cases: a null text and an empty text give an empty list; special
tokens are ordinary text; a lone surrogate cannot occur in a Spark string;
repeated rows are encoded as often as they occur; the longest text is encoded
whole, since a block holds at least one document.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.tables import load

TOKENIZERS = os.environ.get("STRATALOG_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = os.path.join(TOKENIZERS, "byte_bpe_50k.json")

#: Characters of text that one block may hold beyond its last document.
BLOCK_CHARS = 12_000_000

# The splitting pattern of the tokenizer; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of ASCII only, in the classes of the standard library.
PATTERN_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class MergeTable:
    """Byte ids and merges of a vocabulary: pair key -> (rank, new id)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[c] for c in _byte_chars()], dtype=np.int64)
        self.base = len(vocab) + 1
        self.rank: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault(vocab[a] * self.base + vocab[b], (r, vocab[a + b]))
        self.words = regex.compile(PATTERN).findall
        self.ascii_words = re.compile(PATTERN_ASCII).findall

    def split(self, text: str) -> list[str]:
        return self.ascii_words(text) if text.isascii() else self.words(text)

    def replay(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the number of tokens of each word."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        # a mark before every word, and one at the end: a pair with a mark is in no merge
        starts = np.cumsum(sizes) - sizes + np.arange(1, len(raw) + 1)
        total = len(data) + len(raw) + 1
        flat = np.full(total, -1, np.int64)
        inside = np.ones(total, bool)
        inside[starts - 1] = inside[-1] = False
        flat[inside] = self.byte_id[data]
        sym = flat.tolist()
        nxt, prv = list(range(1, total + 1)), list(range(-1, total - 1))
        base, rank = self.base, self.rank

        index: dict[int, list[int]] = {}
        heap: list[tuple[int, int]] = []
        pairs = np.where(inside[:-1] & inside[1:], flat[:-1] * base + flat[1:], -1)
        order = np.argsort(pairs, kind="stable")
        keys, first = np.unique(pairs[order], return_index=True)
        ends = [*first[1:].tolist(), len(order)]
        for k, a, b in zip(keys.tolist(), first.tolist(), ends):
            if k >= 0 and (m := rank.get(k)):
                index[k] = order[a:b].tolist()
                heap.append((m[0], k))
        heapq.heapify(heap)
        push, pop, look = heapq.heappush, heapq.heappop, rank.get
        while heap:
            _, key = pop(heap)
            places = index.pop(key, None)
            if places is None:
                continue
            left, right = divmod(key, base)
            new = rank[key][1]
            if left == right:  # overlapping places: from left to right
                places.sort()
            for i in places:
                if sym[i] != left:
                    continue
                j = nxt[i]
                if sym[j] != right:
                    continue
                sym[i] = new
                sym[j] = -2
                k = nxt[j]
                nxt[i] = k
                prv[k] = i
                s = sym[k]
                if s >= 0:
                    q = new * base + s
                    if q in index:
                        index[q].append(i)
                    elif m := look(q):
                        index[q] = [i]
                        push(heap, (m[0], q))
                p = prv[i]
                s = sym[p]
                if s >= 0:
                    q = s * base + new
                    if q in index:
                        index[q].append(p)
                    elif m := look(q):
                        index[q] = [p]
                        push(heap, (m[0], q))
        out = np.array(sym, np.int64)
        live = out >= 0
        counts = np.add.reduceat(live.astype(np.int64), starts - 1)
        return out[live].astype(np.int32), counts


class _Numbered(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


@functools.lru_cache(maxsize=2)
def table(path: str) -> MergeTable:
    return MergeTable(path)


def encode_block(texts: list, path: str = BYTE_BPE) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in one array, and the number of ids of each text."""
    t = table(path)
    number = _Numbered()
    get = number.__getitem__
    at, per_text = [], np.zeros(len(texts), np.int64)
    for i, x in enumerate(texts):
        if x:
            w = np.fromiter(map(get, t.split(x)), np.int32)
            per_text[i] = len(w)
            at.append(w)
    if not at:
        return np.zeros(0, np.int32), per_text
    ids, counts = t.replay(list(number))
    words = np.concatenate(at)
    n = counts[words]
    ends = np.cumsum(n)
    first = np.cumsum(counts) - counts
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[words] - (ends - n), n)
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
    return ids[where], np.diff(bounds)


def _blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    held, chars = [], 0
    for b in batches:
        for k in range(0, b.num_rows, 500):
            part = b.slice(k, 500)
            held.append(part)
            chars += part.column(column).nbytes
            if chars >= limit:
                yield pa.Table.from_batches(held)
                held, chars = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode(df: DataFrame, key: str, text: str = "text", path: str = BYTE_BPE, block: int = BLOCK_CHARS) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        for t in _blocks(batches, "__text", block):
            ids, n = encode_block(t.column("__text").to_pylist(), path)
            # lists of one batch stay far below the offset limit of 2^31
            ends = np.concatenate([[0], np.cumsum(n)])
            for a in range(0, t.num_rows, 2000):
                b = min(a + 2000, t.num_rows)
                off = pa.array((ends[a : b + 1] - ends[a]).astype(np.int32))
                lists = pa.ListArray.from_arrays(off, pa.array(ids[ends[a] : ends[b]]))
                yield pa.RecordBatch.from_arrays([t.column("__key").slice(a, b - a).combine_chunks(), lists], [key, "ids"])

    return df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str = BYTE_BPE, block: int = BLOCK_CHARS) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of ids of the text."""
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("tokens", T.LongType(), False)])

    def run(batches):
        for t in _blocks(batches, "__text", block):
            _, n = encode_block(t.column("__text").to_pylist(), path)
            yield from t.select(list(keep)).append_column("tokens", pa.array(n)).combine_chunks().to_batches()

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"), "doc_id")


def p8_lengths(spark, sf_dir: str) -> DataFrame:
    """Number of tokens and of code points per source and language as declared."""
    d = count_tokens(load(spark, sf_dir, "documents"), ["source", "lang", "n_chars"])
    return d.groupBy("source", "lang").agg(
        F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.sum("n_chars").alias("chars")
    )
