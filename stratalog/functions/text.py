"""Text functions of the store as Spark columns; all but the snippet stay inside generated code."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_.\-]+"

# Words that carry no meaning of their own in a query; fixed values.
STOPWORDS = (
    "a about after again all also an and any are as at be because been before but by can could did do does for from get had has have he her his how i if in into is it "
    "its just may me might more most must my no not of on only or our over should so some such than that the their them then there these they this to too under very was we "
    "were what when where which who why will with would you your"
).split()
# Cues that turn a statement around; fixed values.
NEGATIONS = ("not", "never", "don't", "dont", "doesn't", "doesnt", "isn't", "isnt", "won't", "wont", "no longer", "avoid", "instead", "deprecated", "wrong", "refuting", "refuted")
# Shapes of secrets in text; fixed values.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "cloud_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "forge_token": r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b|\bglpat-[A-Za-z0-9_\-]{20,}\b",
    "chat_token": r"\bxox[abprs]-[A-Za-z0-9\-]{10,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\b",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c) -> Column:
    return F.coalesce(_c(c), F.lit(""))


@functools.lru_cache(1)
def _folds() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they are made of."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))) for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0].lower()) for c, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def fold_text(s: str) -> str:
    """Lower case without accents."""
    return s.translate(str.maketrans(*_folds())).lower()


def folded(c) -> Column:
    return F.lower(F.translate(text_of(c), *_folds()))


def tokens(c) -> Column:
    """Runs of letters, digits, ``_``, ``-`` and ``.``, in lower case."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(TOKEN), F.lit(0))


def comparison_tokens(c) -> Column:
    """Distinct tokens without marks at their edges."""
    t = F.transform(tokens(c), lambda x: F.regexp_replace(x, r"^[._\-]+|[._\-]+$", ""))
    return F.array_distinct(F.filter(t, lambda x: x != ""))


def significant_words(c) -> Column:
    """Distinct words of more than three characters."""
    return F.array_distinct(F.filter(tokens(c), lambda x: F.length(x) > 3))


def jaccard(a, b) -> Column:
    """Of two sets; 0 when either is empty."""
    a, b = _c(a), _c(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def negated(c) -> Column:
    low = F.lower(text_of(c))
    out = F.lit(False)
    for n in NEGATIONS:
        out = out | low.contains(n)
    return out


def negation_mismatch(a, b) -> Column:
    return negated(a) != negated(b)


def is_reword(a, b) -> Column:
    """Whether one text only rewords the other: equal word sets, a small addition to a subset, or a Jaccard of 0.85."""
    x, y = comparison_tokens(a), comparison_tokens(b)
    small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    both = F.size(F.array_intersect(x, y))
    equal = (both == F.size(x)) & (both == F.size(y))
    subset = (both == small) & (small >= 4) & (large - small <= F.greatest(F.floor(small / 2), F.lit(2)))
    return F.when(equal, True).when(negation_mismatch(a, b), False).when(subset, True).otherwise(jaccard(x, y) >= 0.85)


def content_hash(c) -> Column:
    return F.sha2(F.array_join(tokens(c), " "), 256)


def derive_title(c, most: int = 80) -> Column:
    first = F.trim(F.split(F.ltrim(text_of(c)), "\n")[0])
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most), F.lit("…"))).otherwise(first)


def collapse_ws(c) -> Column:
    return F.trim(F.regexp_replace(text_of(c), r"\s+", " "))


def truncate_chars(c, most: int) -> Column:
    c = _c(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def is_stopword(c) -> Column:
    return _c(c).isin(*STOPWORDS)


def is_camel(c) -> Column:
    """A lower-case letter or digit straight before an upper-case one."""
    return _c(c).rlike(r"[\p{Ll}\p{N}]\p{Lu}")


def is_identifier_shaped(c) -> Column:
    """Joined by ``::``, ``_`` or a dot inside, or in camel case."""
    c = _c(c)
    return c.contains("::") | c.rlike(r"[\p{L}\p{N}]_[\p{L}\p{N}]") | c.rlike(r"[\p{L}\p{N}_]\.[\p{L}\p{N}_]") | is_camel(c)


def sanitize_tags(c) -> Column:
    """An array of tags without markup marks, trimmed, empty ones dropped."""
    t = F.transform(_c(c), lambda x: F.trim(F.translate(x, "<>&\"'", "")))
    return F.filter(t, lambda x: x != "")


def sanitize_triggers(c) -> Column:
    """Phrases of up to six words, folded; the first eight."""
    t = F.transform(_c(c), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))
    return F.slice(F.filter(t, lambda x: (x != "") & (F.size(F.split(x, " ")) <= 6)), 1, 8)


def sanitize_anchors(c) -> Column:
    t = F.transform(_c(c), lambda x: F.trim(F.regexp_replace(x, r"^file:", "")))
    return F.slice(F.filter(t, lambda x: (x != "") & (F.length(x) <= 200)), 1, 8)


def parse_expires(c) -> Column:
    """Seconds of ``3h``, ``2d`` or ``1w``; other units give null."""
    c = F.lower(F.trim(_c(c)))
    n = F.regexp_extract(c, r"^(\d{1,9})([hdw])$", 1)
    unit = F.regexp_extract(c, r"^(\d{1,9})([hdw])$", 2)
    size = F.when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return F.when(n != "", n.try_cast("long") * size)


def parse_since(c) -> Column:
    """As ``parse_expires``, with months of 30 and years of 365 days."""
    c = F.lower(F.trim(_c(c)))
    n = F.regexp_extract(c, r"^(\d{1,9})([hdwmy])$", 1)
    unit = F.regexp_extract(c, r"^(\d{1,9})([hdwmy])$", 2)
    size = F.when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800).when(unit == "m", 2592000).when(unit == "y", 31536000)
    return F.when(n != "", n.try_cast("long") * size)


def parse_date(c) -> Column:
    """A date written exactly ``yyyy-MM-dd``; anything else is null."""
    c = _c(c)
    d = F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.date_format(d, "yyyy-MM-dd") == c, d)


def civil_date(seconds) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_c(seconds) / F.lit(86400)).cast("int"))


def short_uid(uid, kind) -> Column:
    """One letter for the kind and the last six characters of the uid."""
    k = _c(kind)
    sigil = F.when(k == "memory", "m").when(k.isin("chunk", "codechunk"), "c").when(k == "symbol", "s").when(k == "file", "f").otherwise("n")
    return F.concat(sigil, F.lit(":"), F.substring(_c(uid), -6, 6))


def estimate_tokens(c) -> Column:
    return F.ceil(F.length(text_of(c)) / F.lit(4))


def estimate_pct(size_bytes, per_token: int = 8, window: int = 200_000) -> Column:
    return F.round(F.least(F.greatest(_c(size_bytes) / F.lit(float(per_token)) / F.lit(float(window)) * 100.0, F.lit(0.0)), F.lit(100.0)), 0)


def strip_ansi(c) -> Column:
    """Without escape sequences, and with what a carriage return overwrote taken away."""
    t = F.regexp_replace(text_of(c), "\\x1B(?:\\[[0-?]*[ -/]*[@-~]|\\][^\\x07\\x1B]*(?:\\x07|\\x1B\\\\)|[@-Z\\\\-_])", "")
    t = F.regexp_replace(t, r"\r\n", "\n")
    return F.regexp_replace(t, r"[^\n]*\r", "")


def secret_kind(c) -> Column:
    """Label of the first secret shape in the text, or null."""
    out = None
    for name, shape in SECRETS.items():
        hit = text_of(c).rlike(shape)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def glob_regex(pattern: str) -> str:
    """A glob whose ``*`` and ``?`` also match a slash, as an anchored pattern."""
    special = set(r".^$+{}[]()|\\")
    return "^" + "".join(".*" if ch == "*" else "." if ch == "?" else ("\\" + ch if ch in special else ch) for ch in pattern) + "$"


def human_bytes(c) -> Column:
    c = _c(c).cast("double")
    return (
        F.when(c >= 1 << 30, F.format_string("%.1f GB", c / (1 << 30))).when(c >= 1 << 20, F.format_string("%.1f MB", c / (1 << 20)))
        .when(c >= 1 << 10, F.format_string("%.1f KB", c / (1 << 10))).otherwise(F.format_string("%d B", c.cast("long")))
    )


def portable_key(url) -> Column:
    """``host/owner/name`` of a remote, however it is written."""
    u = F.lower(F.trim(_c(url)))
    u = F.regexp_replace(u, r"^[a-z+]+://", "")
    u = F.regexp_replace(u, r"^[^@/]*@", "")
    u = F.regexp_replace(u, r"^([^/:]+):(?=[^/0-9])", "$1/")
    return F.regexp_replace(u, r"(?:\.git)?/*$", "")


def meta_text(key: str, meta="meta") -> Column:
    return F.get_json_object(_c(meta), f"$.{key}")


def meta_set(meta, key: str, value) -> Column:
    """JSON text with one key set; broken JSON counts as empty."""
    m = F.coalesce(F.from_json(_c(meta), "map<string,string>"), F.create_map().cast("map<string,string>"))
    m = F.map_filter(m, lambda k, _: k != key)
    return F.to_json(F.map_concat(m, F.create_map(F.lit(key), value.cast("string"))))


def densest(text: str, stems: list[str], most: int, lead: int) -> int:
    """Where the window of ``most`` characters begins that holds the most different stems, some way before the first of
    them; the earliest of equal ones, and the head of the text if none is better."""
    low = "".join(c.lower() if c.isascii() else c for c in text)  # keeps every place
    at = {}
    for s in dict.fromkeys(stems):
        k, hits = low.find(s), []
        while k >= 0:
            hits.append(k)
            k = low.find(s, k + 1)
        if hits:
            at[s] = np.array(hits)
    if not at:
        return 0
    starts = np.unique(np.concatenate([[0], *(np.maximum(v - lead, 0) for v in at.values())]))
    held = np.zeros(len(starts), np.int64)
    for s, v in at.items():
        first = np.searchsorted(v, starts)
        held += (first < len(v)) & (v[np.minimum(first, len(v) - 1)] <= starts + most - len(s))
    return int(starts[held.argmax()])


def snippet(c, terms: list[str], most: int = 120, lead: int = 32) -> Column:
    """The densest part of a text for the terms' first five letters, with signs where something is left out."""
    stems = [t.lower()[:5] for t in terms if len(t) >= 3]

    @F.pandas_udf("int")
    def start(t: pd.Series) -> pd.Series:
        return t.map(lambda x: densest(x, stems, most, lead)).astype("int32")

    t = collapse_ws(c)
    at = start(t) + 1
    cut = F.substring(t, at, F.lit(most))
    return F.concat(F.when(at > 1, F.lit("…")).otherwise(""), cut, F.when(F.length(t) >= at + most, F.lit("…")).otherwise(""))

