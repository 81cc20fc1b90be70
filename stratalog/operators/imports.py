"""Imports of source files and the files they lead to.

``imports`` reads the import statements of a Rust, Python, TypeScript or Go file;
those in comments and strings are none. ``resolve`` gives each import its
candidate paths, which meet the set of files by an equi join; the first candidate
that exists wins, and of several files it fits the smallest.
"""

from __future__ import annotations

import ast
import posixpath
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is passed over, then the statements themselves.
_STR = r"\"(?:\\(?s:.)|[^\"\\\n])*\"|'(?:\\(?s:.)|[^'\\\n])*'"
_SKIP = {
    "rust": r"//[^\n]*|(?P<block>/\*)|\bb?r(?P<h>\#*)\"(?s:.*?)\"(?P=h)|b?\"(?:\\(?s:.)|[^\"\\])*\"|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^\\'\n])'|\br\#\w+",
    "typescript": rf"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|{_STR}|`(?:\\(?s:.)|[^`\\])*`",
    "go": r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'",
    "python": rf"\#[^\n]*|(?s:\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|'''(?:\\.|.)*?(?:'''|\Z))|{_STR}",
}
_NOTE = r"(?:\s|//[^\n]*|/\*(?s:.*?)\*/)"
_SAY = {
    "rust": r"(?<![\w.$#])use\b(?!\s*<)(?P<use>[^;\"]*);",
    "typescript": rf"(?<![\w.$#])import\b(?!{_NOTE}*[(.=])(?P<clause>[^;\"'`()=]*?)\bfrom{_NOTE}*(?P<q>[\"'])(?P<src>[^\"'\n]*)(?P=q)",
    "go": r"(?<![\w.])import\b\s*(?:\((?P<list>(?:[^()\"`/]|\"[^\"\n]*\"|`[^`]*`|//[^\n]*|/\*(?s:.*?)\*/)*)\)|(?P<one>(?:[\w.]+\s*)?(?:\"[^\"\n]*\"|`[^`\n]*`)))",
    "python": r"(?:(?<=\n)|(?<=;)|\A)[ \t\f]*(?P<py>(?:from[ \t.]+[\w. \t]*import\b[ \t]*(?:\([^()]*\)|(?:\\\r?\n|[^\n;#])*))|import[ \t]+(?:\\\r?\n|[^\n;#])*)",
}
_FORMS = {k: re.compile(f"(?P<skip>{_SKIP[k]})|{_SAY[k]}") for k in _SKIP}
_COMMENT = re.compile(r"//[^\n]*|/\*(?s:.*?)\*/")
_NEST = re.compile(r"/\*|\*/")
_SPEC = re.compile(r"(?:(?P<name>[\w.]+)\s*)?(?:\"(?P<a>[^\"\n]*)\"|`(?P<b>[^`\n]*)`)")


def _statements(src: str, lang: str):
    at, form = 0, _FORMS[lang]
    while m := form.search(src, at):
        at = m.end()
        if lang == "rust" and m["block"]:  # these nest
            depth = 0
            for x in _NEST.finditer(src, m.start()):
                depth += 1 if x.group() == "/*" else -1
                at = x.end()
                if depth == 0:
                    break
            else:
                return
        elif m["skip"] is None:
            yield m


def _use_tree(tree: str, prefix: str = ""):
    """(local name, path) of a Rust use tree; a wildcard binds no name."""
    tree = tree.strip()
    if tree.endswith("}"):
        path, _, rest = tree[:-1].partition("{")
        path = path.strip().removesuffix("::")
        prefix = f"{prefix}::{path}" if prefix and path else prefix or path
        depth, start = 0, 0
        for k, c in enumerate(rest + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                yield from _use_tree(rest[start:k], prefix)
                start = k + 1
    elif tree and not tree.endswith("*"):
        path, *alias = re.split(r"\s+as\s+", tree)
        path = re.sub(r"\s+", "", path)
        yield (alias[0] if alias else path.rsplit("::", 1)[-1]), f"{prefix}::{path}" if prefix else path


def _python_tree(tree):
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            for a in x.names:
                yield a.asname or a.name.rsplit(".", 1)[-1], a.name
        elif isinstance(x, ast.ImportFrom) and (x.level or x.module != "__future__"):
            for a in x.names:
                if a.name != "*":
                    yield a.asname or a.name, "." * x.level + (x.module or "")


def _parsed(text: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def _python(src: str):
    try:
        return list(_python_tree(_parsed(src.lstrip("\ufeff"))))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    found = []  # a file that does not parse as a whole: statement by statement
    for m in _statements(src, "python"):
        try:
            found += _python_tree(_parsed(m["py"].strip()))
        except (SyntaxError, ValueError):
            continue
    return found


def imports(src: str, lang: str) -> list[tuple[str, str]]:
    """(local name, source as written) of the imports of a file; an unknown language has none."""
    if lang == "python":
        return _python(src)
    found: list[tuple[str, str]] = []
    for m in _statements(src, lang) if lang in _FORMS else ():
        if lang == "rust":
            found += _use_tree(_COMMENT.sub(" ", m["use"]))
        elif lang == "go":
            for s in _SPEC.finditer(_go_specs(m["list"] if m["list"] is not None else m["one"])):
                path = s["a"] if s["a"] is not None else s["b"]
                found.append((s["name"] or path.rsplit("/", 1)[-1], path))
        else:
            clause = re.sub(r"^\s*type\b(?=\s*[\w{*$])(?!\s*,)", "", _COMMENT.sub(" ", m["clause"]))
            named = re.search(r"\{(.*)\}", clause, re.S)
            for part in [*re.sub(r"\{.*\}", "", clause, flags=re.S).split(","), *(named[1].split(",") if named else ())]:
                words = part.split()
                if words:
                    found.append((words[-1], m["src"]))
    return found


def _go_specs(text: str) -> str:
    """Without comments; '//' in a path is none."""
    return re.sub(r"(\"[^\"\n]*\"|`[^`]*`)|//[^\n]*|/\*(?s:.*?)\*/", lambda m: m[1] or " ", text)


def _normal(path: str) -> str:
    parts: list[str] = []
    for p in path.split("/"):
        if p == "..":
            parts[-1:] = []
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def candidates(importer: str, source: str) -> list[tuple[str, str]]:
    """(kind, key) in the order in which they are tried: an exact path, a path's end, or a folder's name."""
    here = posixpath.dirname(importer)
    if source.startswith("."):
        if "::" in source:
            return []
        if source.startswith(("./", "../")):
            p = _normal(f"{here}/{source}")
            return [("exact", p + x) for x in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", "")]
        dots = len(source) - len(source.lstrip("."))
        for _ in range(dots - 1):
            here = posixpath.dirname(here)
        p = _normal(f"{here}/{source[dots:].replace('.', '/')}")
        return [("exact", f"{p}.py"), ("exact", f"{p}/__init__.py")]
    if "::" in source:
        segs = [s for s in source.split("::") if s not in ("crate", "super", "self")]
        return [("end", "/".join(segs[:take]) + ".rs") for take in range(min(3, len(segs)), 0, -1)]
    if "." in source and "/" not in source:
        p = source.replace(".", "/")
        return [("exact", f"{p}.py"), ("exact", f"{p}/__init__.py"), ("end", f"{p}.py")]
    return [("name", source.rsplit("/", 1)[-1])]


def _extract(frames):
    for f in frames:
        out = []
        for file_id, path, lang, content in f.itertuples(index=False):
            for local, source in dict.fromkeys(imports(content, lang)):
                c = candidates(path, source)
                out.append((file_id, path, local, source, [k for k, _ in c], [v for _, v in c]))
        yield pd.DataFrame(out, columns=["file_id", "path", "local", "source", "kinds", "keys"])


def _places(files: DataFrame) -> DataFrame:
    """kind, key, target: what a file can be found by, the smallest path for each key."""
    p = F.col("path")
    ends = F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.substring(p, i, F.length(p)))
    folder = F.regexp_extract(p, r"([^/]+)/+[^/]+$", 1)
    of = lambda kind, key: files.select(F.lit(kind).alias("kind"), key.alias("key"), p.alias("target"))
    every = (
        of("exact", p)
        .unionAll(of("name", folder).filter("key <> ''"))
        .unionAll(of("name", F.regexp_extract(p, r"^([^/]+)\.py$", 1)).filter("key <> ''"))
        .unionAll(files.filter(p.endswith(".rs") | p.endswith(".py")).select(F.lit("end").alias("kind"), F.explode(ends).alias("key"), p.alias("target")))
    )
    return every.groupBy("kind", "key").agg(F.min("target").alias("target"))


def resolve(files: DataFrame) -> DataFrame:
    """``files``: file_id, path, lang, content. Every import once: file_id, local, source and
    the path it leads to, null if that is none of the files."""
    at = files.filter("path is not null")
    schema = "file_id bigint, path string, local string, source string, kinds array<string>, keys array<string>"
    found = at.filter("content is not null").select("file_id", "path", "lang", "content").distinct().mapInPandas(_extract, schema)
    tried = found.select("file_id", "path", "local", "source", F.posexplode_outer(F.arrays_zip("kinds", "keys")).alias("rank", "c"))
    tried = tried.select("file_id", "path", "local", "source", "rank", F.col("c.kinds").alias("kind"), F.col("c.keys").alias("key"))
    hit = tried.join(_places(at.select("path").distinct()), ["kind", "key"], "left")
    best = F.min_by("target", F.when(F.col("target").isNotNull(), F.col("rank")))
    return hit.groupBy("file_id", "path", "local", "source").agg(best.alias("target")).select("file_id", "local", "source", "target")
