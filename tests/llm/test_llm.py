"""The llm operators against brute force, exact round trips and cases written by hand."""

import random

import numpy as np
import pytest

from stratalog.llm import alike, catalog, docpairs, mix, neighbours, residue, split, tokenize
from stratalog.llm.syntax import definitions
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    if name in catalog.oracle_sql():
        same(df, duck, catalog.oracle_sql()[name])
    else:
        assert df.columns and not df.isEmpty()


# splitting


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_the_text_within_limits(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(rng.randint(3, 60)):
        parts.append(rng.choice(["# H\n", "\n\n", "\r\n", "```\ncode # x\n```\n", "word " * rng.randint(1, 120), "End. ", "x" * rng.randint(1, 9000)]))
    text = "".join(parts)
    got = split.split_text(text)
    assert got[0][0] <= len(text) - len(text.lstrip()) and all(e - s <= split.MAX_CHARS for s, e, *_ in got)
    last = 0
    for s, e, fresh, words, _ in got:
        assert len(text[s:e].split()) <= split.MAX_WORDS and len(text[s:fresh].split()) <= split.OVERLAP
        assert not text[last:fresh].strip() and s <= fresh < e
        last = e
    assert not text[last:].strip()


def test_pieces_prefer_headings_and_spare_fences():
    text = ("alpha beta gamma delta. " * 60).strip() + "\n\n## Next\n\n" + "one two three four. " * 60
    assert any(text[f:].startswith("## Next") for _, _, f, _, _ in split.split_text(text))


def test_blank_long_and_small_items(spark):
    assert not split.oversized(None) and not split.oversized("a " * 400) and split.oversized("a " * 401) and split.oversized("y" * 4001)
    assert [e - s for s, e, *_ in split.split_text(" " * 9000)] == [4000, 4000, 1000]
    rows = [("node", 1, None, "w " * 900, None, None), ("node", 2, "t", "a\r\n" * 500, 10, 509), ("node", 3, "t", None, 1, 2)]
    df = spark.createDataFrame(rows, "tbl string, item_id long, title string, body string, first long, last long")
    got = split.split_items(df).collect()
    assert {r["item_id"] for r in got} == {1, 2} and all(r["span_start"] is None for r in got if r["item_id"] == 1)
    two = sorted((r["ord"], r["span_start"], r["span_end"]) for r in got if r["item_id"] == 2)
    assert two[0][1] == 10 and two[-1][2] == 509 and two[1][1] <= two[0][2] + 1


# neighbours


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n // 20, dim))
    return (c[rng.integers(0, len(c), n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float32)


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "node_id long, model string, dim int, vec array<float>, extra string")


def test_neighbours_recall_and_copies(spark):
    x = clustered(1500, 24, 1)
    x[100:140] = x[100]  # a group of equal vectors
    rows = [(int(i), "m", 24, v.tolist(), "e") for i, v in enumerate(x)]
    e = embeddings(spark, rows + rows[:50])
    got = neighbours.top_similar(e)
    assert got.groupBy("node_id").count().filter("count <> 10").count() == 0
    assert neighbours.recall(got, e, "m") >= 0.97
    own = {r["neighbour"] for r in got.filter("node_id = 120").collect()}
    assert own == set(range(100, 110))


@pytest.mark.parametrize("rows,trees,take", [(900, 5, 40), (900, 5, 10_000), (30, 3, 8), (3, 2, 4), (1, 2, 4)])
def test_queue_yields_the_cheapest_leaves(rows, trees, take, monkeypatch):
    monkeypatch.setattr(neighbours, "TAKEN", 1)
    x = neighbours.unit(clustered(rows, 8, 3) if rows > 60 else np.random.default_rng(1).standard_normal((rows, 8)))
    grown = [neighbours.grow(x, 8, t) for t in range(trees)]
    f = neighbours.Forest(grown, x, 8)

    def ways(tree, q):
        """Price of every leaf of a tree, by going down all ways."""
        w, c, kids = tree
        out, todo = {}, [(0 if len(w) else -1, 0.0)]
        while todo:
            k, cost = todo.pop()
            if k < 0:
                out[~k] = cost
                continue
            side = float(q @ w[k] - c[k])
            todo += [(int(kids[k][1]), cost if side > 0 else max(cost, -side)), (int(kids[k][0]), cost if side <= 0 else max(cost, side))]
        return out

    leaf, cost = f.queue(x, take)
    for r in range(0, len(x), max(1, len(x) // 20)):
        base, prices = 0, {}
        for t in grown:
            prices |= {base + k: v for k, v in ways(t, x[r]).items()}
            base += len(t[0]) + 1
        got = sorted(set(leaf[r].tolist()))
        assert np.allclose([prices[k] for k in leaf[r].tolist()], cost[r], atol=1e-5)
        if take >= f.leaves:
            assert got == list(range(f.leaves))
        else:
            assert len(got) == take and np.allclose(np.sort(cost[r]), sorted(prices.values())[:take], atol=1e-5)


def test_neighbours_unusable_few_and_empty(spark):
    rows = [
        (1, "m", 2, [1.0, 0.0], None), (2, "m", 2, [0.0, 1.0], None), (3, "m", 2, [0.0, 0.0], None), (4, "m", 2, [float("nan"), 1.0], None),
        (5, "m", 2, [1.0], None), (6, "m", 2, None, None), (7, "m", 2, [], None), (8, "k", 2, [1.0, 1.0], None), (9, "m", 2, [1e30, 1e30], None),
    ]
    got = {(r["node_id"], r["neighbour"]) for r in neighbours.top_similar(embeddings(spark, rows)).collect()}
    assert got == {(a, b) for a in (1, 2, 9) for b in (1, 2, 9) if a != b}
    assert neighbours.top_similar(embeddings(spark, [])).count() == 0


# functions and documentation


def quals(src, lang):
    return {docpairs.qualified(d, lang): d.doc for d in definitions(src, lang)}


def test_rust_items():
    src = '''/// Top.
#[inline]
// plain
pub async fn a<T>(x: T) -> Vec<T> { let s = "fn no() {}"; fn inner() {} }
//// not doc
fn b() {}
mod m { impl<T: Clone> fmt::Display for Wrap<T> where T: X { /** Block doc. */ fn f(&self) {} } }
trait Tr { #[doc = "Attr doc."] fn need(&self); }
macro_rules! mk { () => { fn hidden() {} } }
const R: &str = r#"fn raw() {}"#;
'''
    got = quals(src, "rust")
    assert set(got) == {"a", "inner", "b", "Wrap::f", "Tr::need"}
    assert got["a"].strip() == "Top." and got["b"] is None and got["Wrap::f"].strip() == "Block doc." and got["Tr::need"] == "Attr doc."


def test_typescript_items():
    src = """/** Doc one. */
export const go = async (a: number): Promise<void> => { const x = `${function no() {}}`; };
/* plain */
function two(): { a: number } { return { a: 1 } }
/** Class. */
export class K<T> extends L { x = 0; @memo() /** no */ private static async run<U>(a: U): Promise<U> { return a } get v() { return /}/.test('') } }
"""
    got = quals(src, "typescript")
    assert {"go", "two", "K.run", "K.v"} <= set(got) and got["go"].strip() == "Doc one." and got["two"] is None


def test_go_and_python_items():
    src = "package p\n\n// Doc of F.\n//go:noinline\nfunc F(a int) error { return nil }\n\n// lost\n\nfunc (r *Box[T]) Get() T {\n\treturn r.v\n}\n"
    assert quals(src, "go") == {"F": " Doc of F.", "Box.Get": None}
    src = 'class A:\n    async def f(self):\n        """Does it."""\n        def g(): pass\ndef h():\n    x = "def no(): pass"\n'
    assert quals(src, "python") == {"A.f": "Does it.", "A.g": None, "h": None}


@pytest.mark.parametrize("doc", ["", "  ...", "TODO", "todo: document", "To do.", "n/a", "TODO(docs)", "@param limit", ":param limit:", "* `limit`", "Returns:", "The read shard.", "READ_SHARD", "Todo: add docs here", "TODO(limit)\nTODO(x)", "-----"])
def test_trivial(doc):
    assert docpairs.trivial(doc, "read_shard", ["limit", "x"])


@pytest.mark.parametrize("doc", ["Reads a shard.", "@param limit how many", "* `limit`: how many", "TODO: drop the copy.", "Returns the shard held."])
def test_not_trivial(doc):
    assert not docpairs.trivial(doc, "read_shard", ["limit"])


def test_functions_of_a_broken_python_file():
    src = "import x\n\ndef fine(a):\n    'Says what it does.'\n\nclass Kept:\n    @wrap\n    def one(self):\n        'First of them.'\n        def inner():\n            pass\n\n    def broken(self:\n        pass\n\n    async def two(self):\n        'Second é of them.'\n\n@wrap\ndef last():\n    'The last one.'\n    if 1:\n        try:\n            pass\n        finally:\n            def deep(): pass\n"
    got = {docpairs.qualified(d, "python"): (d.doc, src[d.start : d.end].split("\n")[0]) for d in definitions(src, "python")}
    assert got == {
        "fine": ("Says what it does.", "def fine(a):"), "Kept.one": ("First of them.", "def one(self):"), "Kept.inner": (None, "def inner():"),
        "Kept.two": ("Second é of them.", "async def two(self):"), "last": ("The last one.", "def last():"), "deep": (None, "def deep(): pass"),
    }
    whole = src.replace("broken(self:", "broken(self):")
    assert {docpairs.qualified(d, "python") for d in definitions(whole, "python")} == got.keys() | {"Kept.broken"}


def test_pairs_of_odd_files(spark):
    rows = [(1, "a.py", "python", "def broken(:"), (2, "b.py", "python", None), (3, "c.py", None, "def f(): pass"), (4, "d.xx", "cobol", "x"), (5, "e.py", "PYTHON", 'def f():\n    "Does much."')]
    df = spark.createDataFrame(rows, "file_id long, path string, lang string, content string")
    assert [(r["file_id"], r["start_line"], r["end_line"]) for r in docpairs.doc_pairs(df).collect()] == [(5, 1, 2)]
    assert [r["file_id"] for r in docpairs.refused_files(df).collect()] == [1]


# near duplicates


def brute_links(sets):
    out = set()
    for a in sets:
        for b in sets:
            if a < b:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    out.add((a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_alike_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(150)]
    texts = [rng.sample(vocab, rng.randint(9, 40)) for _ in range(60)]
    for _ in range(90):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(t + rng.sample(vocab, rng.randint(0, 6)))
    rows = [(i, rng.choice(["memory", "chunk", "file"]), rng.choice([None, "W1 x"]), " ".join(t).upper()) for i, t in enumerate(texts)]
    rows += [(900, "memory", "t", None), (901, "memory", "t", "  "), (902, "chunk", None, rows[0][3]), (903, "chunk", None, rows[0][3])]
    df = spark.createDataFrame(rows + rows[:5], "id long, kind string, title string, body string")
    sets = {i: alike.words_of(t, b) for i, k, t, b in rows if k != "file" and b and b.strip()}
    sets = {i: s for i, s in sets.items() if len(s) >= 10}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_links(sets):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {(a, b) for a in sets for b in sets if a < b and find(a) == find(b)}
    member, links, _ = alike.groups(df)
    got = [(r["node_a"], r["node_b"]) for r in alike.pairs_of_groups(member).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    reps = {r["id"]: r["rep"] for r in member.collect()}
    assert {(r["a"], r["b"]) for r in links.collect()} == {(min(p), max(p)) for p in ((reps[a], reps[b]) for a, b in brute_links(sets)) if p[0] != p[1]}


@pytest.mark.parametrize("seed,heavy,rest,rows,entries", [(1, 4096, 256, 10**6, 10**6), (2, 7, 256, 60, 90), (3, 5, 3, 40, 50), (4, 4096, 1, 10**6, 10**6)])
def test_alike_trees_against_brute_force(seed, heavy, rest, rows, entries, monkeypatch):
    """The trees miss no link: in blocks of a heavy word, with cut rests and in small steps."""
    from types import SimpleNamespace

    import pyarrow as pa

    for name, v in (("HEAVY", heavy), ("REST", rest), ("ROWS", rows), ("ENTRIES", entries)):
        monkeypatch.setattr(alike, name, v)
    rng = random.Random(seed)
    words = [rng.getrandbits(64) for _ in range(300)]
    sets = [frozenset(rng.sample(words, rng.choice([10, 12, 25, 60, 150]))) for _ in range(40)]
    for _ in range(120):
        s = set(rng.choice(sets))
        for _ in range(rng.randint(0, 1 + len(s) // 6)):
            s.discard(rng.choice(sorted(s)))
        s |= set(rng.sample(words, rng.randint(0, 1 + len(s) // 8)))
        if len(s) >= 10:
            sets.append(frozenset(s))
    sets = dict(enumerate(dict.fromkeys(sets)))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    batch = pa.RecordBatch.from_arrays([pa.array(list(sets)), pa.array([list(map(signed, s)) for s in sets.values()], pa.list_(pa.int64()))], ["id", "toks"])
    count = lambda keys: np.array([np.bincount(k, minlength=1 << alike.BUCKET_BITS) for k in keys(batch)])
    order = SimpleNamespace(value=alike.WordOrder(count(alike._buckets)[0]))
    tally = SimpleNamespace(value=count(alike._prefix_ranks(order)))
    t = pa.Table.from_batches(alike._branches(order, tally)([batch]))
    t = t.sort_by([(k, "ascending") for k in ("word", "cell", "n", "id")])
    got = {(int(a), int(b)) for r in alike._trees(t.to_batches(max_chunksize=17)) for a, b in zip(r["a"].to_numpy(), r["b"].to_numpy())}
    want = brute_links(sets)
    assert len(want) > 20 and want <= got
    assert rest < 256 or len(got) < 20 * len(want)


def test_alike_empty(spark):
    df = spark.createDataFrame([], "id long, kind string, title string, body string")
    member, _, _ = alike.groups(df)
    assert alike.pairs_of_groups(member).count() == 0


def test_alike_is_measured_by_the_union(spark):
    w = [f"w{i}" for i in range(30)]
    rows = [(1, w[:16]), (2, w[:20]), (3, w[:12] + w[20:24]), (4, w[:13])]
    member, links, _ = alike.groups(spark.createDataFrame([(i, "memory", None, " ".join(t)) for i, t in rows], "id long, kind string, title string, body string"))
    # 16 of 20; 13 of 16; but 12 of 20, and 13 of 20 though all of the smaller record
    assert {(r["a"], r["b"]) for r in links.collect()} == {(1, 2), (1, 4)}


def test_alike_shortest_records_with_a_title(spark):
    rows = [(1, "memory", "a b c d", "e f g h i j"), (2, "memory", None, "a b c d e f g h i j"), (3, "memory", "", "a b c d e f g h i")]
    member, _, _ = alike.groups(spark.createDataFrame(rows, "id long, kind string, title string, body string"))
    assert {(r["node_a"], r["node_b"]) for r in alike.pairs_of_groups(member).collect()} == {(1, 2)}


def test_alike_words_that_share_a_code(spark, monkeypatch):
    """Hashes that differ only where the code does not see it: no false link, and no true one lost."""
    import uuid

    from stratalog.session import Scratch

    h = [(k * 0x9E3779B97F4A7C15) % 2**64 for k in range(1, 40)]
    twin = [v ^ 1 for v in h]
    sets = [(1, h[:10]), (2, h[:8] + twin[8:10]), (3, h[10:18] + twin[10:18]), (4, h[10:18] + twin[10:18] + h[20:21]), (5, h[:9] + h[30:31])]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    rows = [(i, i, i, len(w), [signed(v) for v in w]) for i, w in sets]
    at = spark.createDataFrame(rows, "id long, k1 long, k2 long, n int, toks array<bigint>").coalesce(1)
    scratch = Scratch(spark, f"test-{uuid.uuid4().hex}")
    keep = scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, name: keep(at if name == "sets" else df, name))
    nodes = spark.createDataFrame([], "id long, kind string, title string, body string")
    _, links = alike.similarity_links(nodes, scratch)
    of = {i: set(w) for i, w in sets}
    want = {(a, b) for a in of for b in of if a < b and 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b])}
    assert want == {(1, 5), (3, 4)}
    assert {(r["a"], r["b"]) for r in links.collect()} == want


# tokens


def test_tokens_equal_the_library(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.BYTE_BPE)
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = ["", None, " ", "a\x1cb \x85 \u2003", "it's I'LL", "<|endoftext|>", "aaaaaaaaaa" * 300, "\u0661\u0662 \u00bd", "e\u0301", "\r\n\r\n \t x", "\U0001f600 \u6f22\u5b57"]
    docs = docs.union(spark.createDataFrame([(-i, x) for i, x in enumerate(odd)], "doc_id long, text string"))
    texts = {r[0]: r[1] for r in docs.collect()}
    for r in tokenize.encode(docs, "doc_id", block=5000).collect():
        assert r["ids"] == t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids


# mixing


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 256, 1000):
        got = mix.permute(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(got.tolist()) == list(range(n))


def test_plan_respects_caps_and_size():
    t = mix.plan([dict(source=s, target_share=p, max_repeats=c, blocks=b) for s, p, c, b in (("a", 0.5, 2, 10), ("b", 0.3, 1, 200), ("c", 0.2, 3, 0))])
    assert [x["want"] for x in t] == [20, 190, 0]


def test_mix_shares_and_repeats(spark, sf):
    got = mix.p9_shares(spark, sf).collect()
    for r in got:
        assert r["most_uses"] <= r["max_repeats"] and r["drawn_tokens"] <= r["max_repeats"] * r["source_tokens"]
    for m in {r["mix"] for r in got}:
        assert abs(sum(r["actual_share"] for r in got if r["mix"] == m) - 1) < 1e-9


# residue

CASES = [
    "Lorem ipsum dolor sit amet, velit nulla tellus metus.", "foo bar foo bar foo bar foo bar", "Texto de relleno.", "404 Not Found", "HTTP/1.1 502 Bad Gateway\nThe gateway took too long to answer; try later.",
    "Please enable JavaScript to view this page.", "<noscript>You need to turn on scripts to run this app.</noscript>", "Hello {{ name }}, the review is due.", "Owner: [INSERT OWNER HERE]", "Seite nicht gefunden.",
    "Some words of real content here and there, enough of them.\n\nRelease __VERSION__ is out.", "Acme Docs\n\nAcc\u00e8s refus\u00e9.\n\nIncident 18",
]
PLAIN = [
    None, "", "  \n", "When the upstream answers 502 Bad Gateway, the client retries after 114 ms and notes it.", "Write `{{ name }}` in the header; the tool fills it.", "```sh\nexport D=\"${HOME}/x\"\n```\nThe shell expands it.",
    'Fixed the dialog that said "Please enable JavaScript" although scripts were on: the viewer read the flag too early.', "We replaced the lorem ipsum in the fixtures by generated prose.", "| a | b |\n|---|---|\n| 1 | 2 |",
    "A 404 Not Found from the shelf endpoint is normal for old rows: the entry was archived and the job drops it.",
]


def test_residue_cases(spark):
    texts = CASES + PLAIN
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, CASES[0])], "doc_id long, text string")
    assert {r["doc_id"] for r in residue.judge(df).collect()} == set(range(len(CASES)))
    assert residue.judge(df.limit(0)).count() == 0


def test_messages_are_mined_from_the_corpus(spark):
    """Wordings that no list has: nearly always alone in different texts, so messages; told of among other words, so not."""
    places = "larch birch alder rowan aspen maple".split()
    notice = "Regrettably the reading lounge {} stays shuttered because scripts were switched off nearby"
    told = "Yesterday the curious gardener {} noticed that scripts were switched off nearby"
    much = " Among tall trees many small birds build soft nests every single spring, and nobody disturbs them there."
    texts = [notice.format(p) for p in places] + [told.format(p) + ("." + much if i else "") for i, p in enumerate(places)]
    # copies of one text are no support
    texts += ["Mostly the patient baker grumbles whenever scripts were switched off nearby"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in residue.judge(df).collect()} == set(range(len(places)))
    assert residue.merge(["a b c d e", "a b x d e", "p q r s t"]) == ["a b * d e", "a b * d e", "p q r s t"]


def test_repeated_rows_are_judged_each(spark):
    text = "Larch Birch Alder Rowan Aspen Maple\n\n404 Not Found"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (1, text)], "doc_id long, text string")
    assert sorted(tuple(r) for r in residue.judge(df).collect()) == [(1, "error"), (2, "error")]


def test_messages_beside_code_and_content(spark):
    much = "The larch sheds its needles every autumn, unlike most other conifers, and grows them again in spring when the snow melts."
    cases = [
        "502 Bad Gateway\n\nRequest `a1b2c3`", "404 Not Found\n\n```\nat edge\n```", much + "\n\nPlease enable JavaScript to view this page.\n\n" + much, much + "\n\nThe requested file does not exist any more.",
    ]
    plain = [
        "Not found\n\n```\n" + "larch birch alder " * 5 + "\n```", much + " Please enable JavaScript to view this page. " + much, much + "\n\n# 404 Not Found\n\n" + much, much + "\n\nThe page says:\n\nPlease enable JavaScript to view this page.\n\n" + much,
        much + "\n\n> Please enable JavaScript to view this page.", much + "\n\n```\nPlease enable JavaScript to view this page.\n```\n\n" + much, much + "\n\n404 Not Found\n\n" + much, "`x` `x` `x` `x`",
    ]
    df = spark.createDataFrame(list(enumerate(cases + plain)), "doc_id long, text string")
    assert {r["doc_id"] for r in residue.judge(df).collect()} == set(range(len(cases)))
