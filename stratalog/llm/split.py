"""Splitting oversized items at natural boundaries.

Balanced targets. For a body over a limit the least number of pieces is
computed, as many targets are placed at equal distances, and each target snaps
to the strongest boundary near it: a heading, the edge of a code fence, a blank
line, a line end, a sentence end, a blank. If a piece breaks a limit, the number
of pieces grows and the targets are placed anew. Distance is measured in the
share of whichever limit a word uses up more.

Each piece but the first begins with up to ``overlap`` words of the piece before,
taken from a sentence or line start where there is one, and never from inside a
fence that the earlier piece closed.

Defined cases: a body within the limits, empty or null gives no rows; a body of
blanks alone, or a run of non-blank characters over the limit, is cut by length;
an item without a first line gets pieces without a span; all three kinds of line
end count as one; exact repeats of an item come out once; other columns are not
read.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.tables import load

MAX_WORDS, MAX_CHARS, OVERLAP = 400, 4000, 40
#: How far a target may move, as a share of the distance between targets.
REACH = 0.25

WORD, SENTENCE, LINE, BLANK, FENCE, HEADING = 1, 2, 3, 4, 5, 6
CUT_NAMES = ("length", "word", "sentence", "line", "paragraph", "fence", "heading")

_words = re.compile(r"\S+").finditer
_line_end = re.compile(r"\r\n|\r|\n")
_heading = re.compile(r"#{1,6}[ \t]+\S")
_fence = re.compile(r"[ \t]*(`{3,}|~{3,})")
_stop = re.compile(r"""[.!?…。！？]["'”’»)\]]*$""")


def oversized(text: str | None, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> bool:
    return bool(text) and (len(text) > max_chars or (len(text) > 2 * max_words and len(text.split()) > max_words))


def _units(text: str, max_chars: int) -> list[tuple[int, int]]:
    """Spans of the words; a word longer than half a piece is cut by length."""
    half, out = max(1, max_chars // 2), []
    for m in _words(text):
        a, b = m.span()
        while b - a > half:
            out.append((a, a + half))
            a += half
        out.append((a, b))
    return out


def _boundaries(text: str, units: list[tuple[int, int]]) -> tuple[list[int], list[int], list[bool]]:
    """For each unit: how strong a cut before it is, where the cut lies, whether it is inside a fence."""
    starts = [m.end() for m in _line_end.finditer(text)]
    edges, inside, mark, begun = set(), [], "", 0
    for a in [0, *starts]:
        m = _fence.match(text, a)
        if m and not mark:
            mark, begun = m.group(1), a
            edges.add(a)
        elif m and m.group(1).startswith(mark):
            inside.append((begun, a))
            mark = ""
            k = bisect.bisect_right(starts, a)
            edges.add(starts[k] if k < len(starts) else len(text))
    # a fence that is never closed is no fence
    fence_from = [a for a, _ in inside]
    strength, at, fenced = [HEADING], [0], [False]
    for (_, before), (a, _) in zip(units, units[1:]):
        k = bisect.bisect_right(starts, a)
        line = starts[k - 1] if k else 0
        f = bisect.bisect_left(fence_from, a) - 1
        within = f >= 0 and line > inside[f][0] and line <= inside[f][1]
        fenced.append(within)
        if a == before:
            strength.append(0)
            at.append(a)
        elif line >= before and k:
            blank = bisect.bisect_right(starts, line) - bisect.bisect_left(starts, before) > 1
            if within:
                s = LINE if blank else SENTENCE
            elif _heading.match(text, a):
                s = HEADING
            elif any(before < e <= line for e in (line,) if e in edges) or line in edges:
                s = FENCE
            else:
                s = BLANK if blank else LINE
            strength.append(s)
            at.append(line)
        else:
            strength.append(SENTENCE if not within and _stop.search(text, max(0, before - 8), before) else WORD)
            at.append(a)
    return strength, at, fenced


def _lap(k: int, low: int, overlap: int, strength: list[int], fenced: list[bool]) -> int:
    """First unit of the overlap before unit ``k``, not below ``low``."""
    least = max(low, k - overlap)
    if not fenced[k]:
        while least < k and any(fenced[least:k]):
            least += 1
    for j in range(least, k - 5):
        if strength[j] >= SENTENCE and not fenced[j]:
            return j
    return least


def split_text(text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """Pieces as (start, end, fresh, words, cut): ``text[start:end]`` with ``text[start:fresh]``
    repeated from the piece before; ``cut`` is the strength of the boundary at ``fresh``."""
    overlap = min(overlap, max_words // 2)
    units = _units(text, max_chars)
    if not units:
        return [(a, min(a + max_chars, len(text)), a, 0, 0) for a in range(0, len(text), max_chars)]
    strength, at, fenced = _boundaries(text, units)
    n = len(units)
    used, total = [0.0], 0.0
    for i in range(n):
        step = (units[i + 1][0] if i + 1 < n else units[i][1]) - units[i][0]
        total += max(1 / max_words, step / max_chars)
        used.append(total)
    lap_share = overlap / max_words
    count = max(1, -int(-(total - lap_share) // (1 - lap_share))) if total > 1 else 1
    while True:
        gap = total / count
        cuts, last = [], 0
        for j in range(1, count):
            goal, reach = gap * j, gap * REACH
            lo = max(last + 1, bisect.bisect_left(used, goal - reach))
            hi = min(n - 1, bisect.bisect_right(used, goal + reach) - 1)
            if lo > hi:
                lo = hi = min(max(last + 1, bisect.bisect_left(used, goal)), n - 1)
            if lo <= last:
                continue
            last = min(range(lo, hi + 1), key=lambda k: (-strength[k], abs(used[k] - goal)))
            cuts.append(last)
        pieces, fits = [], True
        for j, (a, b) in enumerate(zip([0, *cuts], [*cuts, n])):
            first = a if j == 0 else _lap(a, pieces[-1][3], overlap, strength, fenced)
            end = units[b - 1][1]
            # the overlap gives way before the limits do
            while first < a and (b - first > max_words or end - at[first] > max_chars):
                first += 1
            if b - first > max_words or end - at[first] > max_chars:
                fits = False
                break
            pieces.append((at[first], end, at[a], a, b - first, strength[a]))
        if fits:
            return [(s, e, f, w, c) for s, e, f, _, w, c in pieces]
        if count >= n:
            return [(u[0], u[1], u[0], 1, 0) for u in units]
        count = min(n, max(count + 1, int(count * 1.02)))


PIECE = (
    "tbl string, item_id bigint, ord int, pieces int, title string, body string, span_start bigint, span_end bigint,"
    " char_start int, char_end int, words int, overlap_words int, cut string"
)


def split_items(items: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``items``: tbl, item_id, title, body, first, last. Returns the pieces of the oversized ones."""

    def run(batches):
        for b in batches:
            cols = {n: [] for n in ("tbl", "item_id", "ord", "pieces", "title", "body", "span_start", "span_end", "char_start", "char_end", "words", "overlap_words", "cut")}
            rows = zip(*(b.column(n).to_pylist() for n in ("tbl", "item_id", "title", "body", "first", "last")))
            for tbl, item, title, text, first, last in rows:
                if not oversized(text, max_words, max_chars):
                    continue
                got = split_text(text, max_words, max_chars, overlap)
                ends = [m.end() for m in _line_end.finditer(text)]
                for i, (s, e, fresh, words, cut) in enumerate(got):
                    top = bottom = None
                    if first is not None:
                        top = first + bisect.bisect_right(ends, s)
                        bottom = first + bisect.bisect_right(ends, max(s, e - 1))
                        if last is not None and last >= first:
                            top, bottom = min(top, last), min(bottom, last)
                    values = (tbl, item, i, len(got), title, text[s:e], top, bottom, s, e, words, len(text[s:fresh].split()), CUT_NAMES[cut])
                    for c, v in zip(cols.values(), values):
                        c.append(v)
            yield pa.RecordBatch.from_pydict(cols, schema=_ARROW)

    # a body of more words than the limit has at least a character and a blank for each
    large = items.filter(F.length("body") > min(max_chars, 2 * max_words))
    return large.mapInArrow(run, PIECE)


_ARROW = pa.schema(
    [
        ("tbl", pa.string()), ("item_id", pa.int64()), ("ord", pa.int32()), ("pieces", pa.int32()), ("title", pa.string()),
        ("body", pa.string()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("char_start", pa.int32()),
        ("char_end", pa.int32()), ("words", pa.int32()), ("overlap_words", pa.int32()), ("cut", pa.string()),
    ]
)


def store_items(spark, sf_dir: str) -> DataFrame:
    node = load(spark, sf_dir, "node").select(
        F.lit("node").alias("tbl"), F.col("id").alias("item_id"), "title", "body",
        F.col("span_start").alias("first"), F.col("span_end").alias("last"),
    )
    chunk = load(spark, sf_dir, "doc_chunk").select(
        F.lit("doc_chunk").alias("tbl"), F.col("chunk_id").alias("item_id"), "title", "body",
        F.col("start_line").alias("first"), F.col("end_line").alias("last"),
    )
    return node.unionByName(chunk)


def p1_found(spark, sf_dir: str) -> DataFrame:
    return split_items(store_items(spark, sf_dir)).select("tbl", "item_id").distinct()


def p1_pieces(spark, sf_dir: str) -> DataFrame:
    return split_items(store_items(spark, sf_dir)).dropDuplicates(["tbl", "item_id", "ord"])
