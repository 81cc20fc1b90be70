"""Files: walking a tree, thought exports, front-matter notes, JSONL and sync snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Lock files that are never indexed, and the greatest size in bytes of prose and settings; fixed values.
LOCKS = ("cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "gemfile.lock", "poetry.lock", "go.sum", "mix.lock", "flake.lock", "pipfile.lock")
MOST_BYTES = 256 * 1024
# Classes of sources by path, the first that fits; fixed values.
CLASSES = [
    ("code", r"\.(?:rs|ts|mts|cts|tsx|jsx|js|mjs|cjs|py|pyi|go|java|rb|rake|c|cpp|cc|cxx|hpp|hxx|h|cs|csx|kt|kts|swift|php|sql)$"),
    ("markdown", r"\.(?:md|markdown)$"),
    ("config", r"\.(?:toml|yaml|yml|json|ini|sh|bash)$|(?:^|/)(?:Dockerfile|Makefile)$|\.env\.example$"),
    ("prose", r"\.(?:txt|rst)$"),
]


def classify_path(path="path"):
    """Class of a source by its path; what fits no class is skipped."""
    out = None
    for name, shape in CLASSES:
        hit = F.col(path).rlike(shape)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("skipped")


def _strip(c) -> F.Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """The pattern of a line of an ignore file, and whether it excludes (``!`` takes back); null for comments."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.lstrip("!")
    rooted, line = "/" in line.rstrip("/"), line.strip("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            out, i = out + "[" + re.sub(r"^!", "^", line[i + 1 : end]).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"{'^' if rooted else '(?:^|/)'}{out}(?:/|$)", not back


def ignored(path, lines: list[str]) -> F.Column:
    """Whether the last matching line of an ignore file excludes the path, which is relative to the file's folder."""
    rules = [r for r in map(ignore_pattern, lines) if r]
    return F.coalesce(*[F.when(F.col(path).rlike(p), F.lit(out)) for p, out in reversed(rules)], F.lit(False))


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """path, size, mtime, content of the files to index under a folder. Only prose and settings have a greatest size."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    f = f.filter((classify_path().isin("code", "markdown") | (F.col("length") <= MOST_BYTES)) & ~base.isin(*LOCKS) & ~(base.startswith(".env") & (base != ".env.example")) & ~F.col("path").contains("/.git/"))
    inside = F.element_at(F.split("path", re.escape(root.rstrip("/") + "/"), 2), -1)
    f = f.withColumn("__inside", inside)
    f = f.filter(~ignored("__inside", ignore or []))
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


# Kinds of thoughts in an export, and types of notes, and what they become; the rest are notes. Fixed values.
THOUGHTS = {"observation": "insight", "reference": "note", "idea": "idea", "task": "note", "person_note": "person"}
NOTE_TYPES = {"feedback": "insight", "user": "person"}


def thoughts(spark: SparkSession, path: str) -> DataFrame:
    """Items of a numbered export: ``12. [3/14/2024] (decision - a, b)`` with an indented body."""
    head = r"^(\d+)\. \[(\d{1,2}/\d{1,2}/\d{4})\] \((\w+)(?: - (.*))?\)\s*$"
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))
    h = F.col("line").rlike(head)
    t = t.withColumn("item", F.sum(F.when(h, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("no"))).filter("item > 0")
    g = t.groupBy("file", "item").agg(
        F.max(F.when(h, F.col("line"))).alias("head"), F.sort_array(F.collect_list(F.when(~h, F.struct("no", F.trim("line").alias("line"))))).alias("rest")
    )
    x = lambda k: F.regexp_extract("head", head, k)
    kind = F.coalesce(F.create_map(*[F.lit(v) for kv in THOUGHTS.items() for v in kv])[x(3)], F.lit("note"))
    return g.select(
        "file", x(1).cast("long").alias("number"), F.to_date(x(2), "M/d/yyyy").alias("date"), kind.alias("subkind"),
        F.filter(F.transform(F.split(x(4), ","), lambda w: F.trim(w)), lambda w: w != "").alias("tags"),
        _strip(F.array_join(F.transform("rest", lambda r: r["line"]), "\n")).alias("body"),
    )


def notes(spark: SparkSession, folder: str, index: str = "MEMORY.md") -> DataFrame:
    """Markdown notes with a ``type:`` in their front matter; the index file is skipped."""
    t = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.input_file_name().alias("file"), "value")
    t = t.filter(~F.col("file").endswith("/" + index))
    front = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    kind = F.lower(F.regexp_extract(front, r"(?m)^type:\s*(\S+)\s*$", 1))
    body = _strip(F.regexp_replace("value", r"(?s)\A---\s*\n.*?\n---\s*\n", ""))
    return t.select("file", F.coalesce(F.create_map(*[F.lit(v) for kv in NOTE_TYPES.items() for v in kv])[kind], F.lit("note")).alias("subkind"), body.alias("body"))


def collections(text: str) -> list[tuple[str, str]]:
    """(name, path) of a two-level list of collections; other keys are skipped."""
    out, name, inside = [], None, False
    for line in text.splitlines():
        bare = line.split("#", 1)[0].rstrip()
        if not bare.strip():
            continue
        depth, word = len(bare) - len(bare.lstrip()), bare.strip()
        if depth == 0:
            inside = word == "collections:"
        elif inside and word.endswith(":") and depth <= 2:
            name = word[:-1]
        elif inside and name and word.startswith("path:"):
            out.append((name, word[5:].strip().strip("'\"")))
    return out


def export_jsonl(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Live nodes, then authored edges between live nodes, one JSON object a line."""
    live = nodes.filter("deleted_at is null")
    ids = live.select("id")
    e = edges.filter("rel <> 'co_recalled'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    n = live.select(F.lit(0).alias("o"), "id", F.to_json(F.struct(F.lit("node").alias("what"), *live.columns)).alias("value"))
    e = e.select(F.lit(1).alias("o"), "id", F.to_json(F.struct(F.lit("edge").alias("what"), *edges.columns)).alias("value"))
    n.unionByName(e).orderBy("o", "id").select("value").write.mode("overwrite").text(path)


def write_snapshot(changes: DataFrame, folder: str, machine: str) -> None:
    """This machine's snapshot as JSON under the shared folder."""
    changes.write.mode("overwrite").json(f"{folder.rstrip('/')}/{machine}")


def read_peers(spark: SparkSession, folder: str, machine: str, schema) -> DataFrame:
    """All snapshots but the machine's own and hidden ones."""
    f = spark.read.schema(schema).option("recursiveFileLookup", True).json(folder)
    peer = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return f.withColumn("peer", peer).filter((F.col("peer") != machine) & ~F.col("peer").startswith("."))
