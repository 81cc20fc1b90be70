"""Functions paired with their documentation.

Each source file is parsed into a syntax tree; its function nodes give the
qualified name, the signature, the exact lines and the attached documentation.
Pairs whose documentation is empty or trivial are dropped.

Defined cases: null or empty content and unknown languages give no rows; of a
Python file that does not parse the functions that parse by themselves come out;
a file that is not read whole is listed by ``refused_files``; copied files give rows under each id; exact repeats count once; two functions of one
name in a file both come out of ``doc_pairs``.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.syntax import Def, read
from stratalog.tables import load

# Words that stand for missing documentation, and those a request to write it is made of; fixed values.
MARKS = ("todo", "tbd", "fixme", "xxx", "wip", "hack", "na", "none", "undocumented", "tba")
REQUEST = ("document", "documentation", "docs", "doc", "docstring", "comment", "describe", "description", "write", "add", "fill", "in", "me",
           "this", "the", "that", "it", "please", "a", "here", "missing", "needed", "needs", "function", "method", "explain", "later", "to", "be", "is", "not", "yet")
ARTICLES = ("the", "a", "an", "this")
SECTIONS = ("args", "arguments", "parameters", "params", "param", "returns", "return", "raises", "throws", "yields", "errors", "panics",
            "safety", "example", "examples", "note", "notes", "see", "attributes", "type", "rtype")

_camel = re.compile(r"[^\W\d_]+|\d+")
_parts = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+|\d+")


def name_words(name: str) -> list[str]:
    out = []
    for w in _camel.findall(name):
        out += [p.lower() for p in _parts.findall(w)] or [w.lower()]
    return out


def trivial(doc: str | None, name: str, params: list[str] = ()) -> bool:
    """Whether nothing is left of the documentation but what says nothing."""
    if doc is None:
        return True
    left = []
    for line in re.split(r"\r\n|\r|\n", doc):
        line = line.strip()
        # a mark that names a person or a parameter and says no more: TODO(x)
        line = re.sub(r"^(?:todo|fixme|xxx|tbd|hack)\s*\(\s*[\w.-]*\s*\)\s*[:.]?$", "", line, flags=re.I)
        # tags: @param x, :param x:, # Arguments, Args:, * `x`, - x:
        m = re.match(r"[@\\:](\w+)(.*)$", line)
        if m and m.group(1).lower() in (*SECTIONS, "arg", "argument", "raise", "exception", "deprecated", "internal", "public", "private", "async", "template", "override", "throw", "yield", "keyword", "key", "var"):
            rest = m.group(2)
            tag = m.group(1).lower()
            rest = re.sub(r"\{[^}]*\}", " ", rest)
            if tag in ("param", "arg", "argument", "template", "key", "keyword", "var", "type", "parameter"):
                rest = re.sub(r"^\s*(?:[\w.\[\], ]+?(?=:)|\[?[\w.$]+(?:=[^\]]*)?\]?)", " ", rest, count=1)
            elif tag in ("raises", "raise", "throws", "exception") and rest.lstrip().count(":"):
                rest = rest.split(":", 1)[1]
            line = rest
        elif re.fullmatch(r"#*\s*(?:" + "|".join(SECTIONS) + r")\s*:?\s*-*", line, re.I):
            line = ""
        else:
            m = re.match(r"[-*+]?\s*[`*]{0,2}([\w.$]+)[`*]{0,2}\s*(?:\([^)]*\))?\s*[:\-–—]*\s*$", line)
            if m and m.group(1) in params:
                line = ""
        left.append(line)
    text = "\n".join(left)
    words = _camel.findall(text)
    if not words:
        return True
    low = [w.lower() for w in words]
    joined = "".join(low)
    if joined in ("na", "notavailable", "notapplicable"):
        return True
    seq = low
    if seq[:2] == ["to", "do"]:
        seq = ["todo", *seq[2:]]
    elif seq[:2] == ["n", "a"]:
        seq = ["na", *seq[2:]]
    if seq[0] in MARKS and all(w in MARKS or w in REQUEST for w in seq[1:]) and (len(seq) == 1 or any(w.startswith(("doc", "descri", "comment", "explain")) or w in MARKS for w in seq[1:])):
        return True
    own = name_words(name)
    split = [p for w in words for p in name_words(w)]
    for k in (0, 1):
        if k and not (split and split[0] in ARTICLES):
            break
        if split[k:] == own or "".join(split[k:]) == "".join(own):
            return True
    return all(w in params for w in words)


def _signature(src: str, d: Def) -> str:
    s = re.sub(r"\s+", " ", src[d.head[0] : d.head[1]]).strip()
    return s.rstrip("{").rstrip() if not s.startswith(("def ", "async def ")) else re.split(r"\s*:\s*(?:[#\"'rRbBuU]|$)", s)[0]


def qualified(d: Def, lang: str) -> str:
    return ("::" if lang == "rust" else ".").join((*d.types, d.name))


PAIR = "file_id bigint, path string, lang string, qualified string, name string, signature string, doc string, start_line int, end_line int, code string, ok boolean"


def _rows(frames):
    for f in frames:
        out = []
        for fid, path, lang, src in f.itertuples(index=False):
            if not src or not isinstance(lang, str):
                continue
            try:
                defs, whole = read(src, lang)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                defs, whole = [], False
            if not whole:
                out.append((fid, path, lang, None, None, None, None, None, None, None, False))
            ends = [m.end() for m in re.finditer(r"\r\n|\r|\n", src)] if defs else []
            line = lambda at: bisect.bisect_right(ends, at) + 1
            for d in defs:
                if not trivial(d.doc, d.name, d.params):
                    doc = "\n".join(x.strip() for x in re.split(r"\r\n|\r|\n", d.doc)).strip()
                    out.append((fid, path, lang, qualified(d, lang), d.name, _signature(src, d), doc, line(d.start), line(d.end), src[d.start : d.end], True))
        yield pd.DataFrame(out, columns=["file_id", "path", "lang", "qualified", "name", "signature", "doc", "start_line", "end_line", "code", "ok"])


def parsed(files: DataFrame) -> DataFrame:
    """``files``: file_id, path, lang, content. Pairs, and a row with ok = false per refused file."""
    return files.select("file_id", "path", F.lower("lang").alias("lang"), "content").mapInPandas(_rows, PAIR)


def doc_pairs(files: DataFrame) -> DataFrame:
    return parsed(files).filter("ok").drop("ok")


def refused_files(files: DataFrame) -> DataFrame:
    return parsed(files).filter("not ok").select("file_id", "path", "lang")


def p4_found(spark, sf_dir: str) -> DataFrame:
    return doc_pairs(load(spark, sf_dir, "source_file")).select("file_id", "qualified").distinct()


def p4_pairs(spark, sf_dir: str) -> DataFrame:
    return doc_pairs(load(spark, sf_dir, "source_file")).distinct()


def p4_refused(spark, sf_dir: str) -> DataFrame:
    """Files by language, and how many of them were not read whole."""
    files = load(spark, sf_dir, "source_file").filter("content is not null").select("file_id", "path", "lang", "content").distinct()
    bad = refused_files(files).select("file_id", F.lit(1).alias("bad")).distinct()
    return files.join(bad, "file_id", "left").groupBy(F.lower("lang").alias("lang")).agg(F.countDistinct("file_id").alias("files"), F.count("bad").alias("refused"))
