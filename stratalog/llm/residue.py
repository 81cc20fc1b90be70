"""Template residue and error-page text.

Three kinds of evidence, each over the whole text:

* Messages. Each distinct shape of a line or sentence (words outside the vocabulary
  of notices left open) is classified once (error, script, filler, furniture or
  content) and its verdict goes back to the documents by a join. Messages that have
  a cue but words of their own too are mined over the corpus: routed through a
  prefix tree of fixed depth (number of words, then first words), merged with the
  similar ones of their leaf, the positions that vary made wildcards. A template
  that enough different texts have, and that nearly always stands alone in them, is
  a message whatever its words; a sentence that quotes a message or tells of it
  stands among others. A document is an error page or a script notice when it has
  such a message and hardly any word of content beside it, or when a notice known
  word for word is a paragraph of its own, whatever else the text holds.
* Unresolved slots: placeholders left standing in prose. Code, fenced or inline,
  shows placeholders on purpose and is taken out first.
* Filler: paragraphs of mock Latin or of one short unit repeated over and over.

Defined cases: null, empty and blank texts are no cases; a document with exact
copies is judged alike in each; ids may repeat and are reported once; an empty
table gives no rows; a very long text is read whole.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import Scratch
from stratalog.tables import load

# The vocabulary of notices, by language; fixed values.
ENGLISH = (
    "a access active again ad address afterwards allow allowed an and any app are at back backend bad be been before blocker browser busy by can "
    "cannot checking coming condition content continue cookies copy could denied description disable disabled displayed does down due dummy enable "
    "encountered error exist execution expired file first follow for forbidden found from gateway go goes gone has have here home human id if "
    "in internal is it java-script javascript js later layout lives loading located longer maintenance many may me met minutes moved "
    "must need needed network no not nothing of off on oops open or our overloaded owner page paragraph permission permitted placeholder please "
    "publish refused reload removed replace reply request requested required requires resource run sample scripting script scripts seconds sent "
    "server servers service session settings shortly side sign site so something sorry start support supported switch switched temporarily text "
    "that the there this time timeout to too took try turn turned unauthorized unavailable unexpected unusable upkeep upstream use valid verifying "
    "view viewer was way we we'll went while will wrong you your activate broke http long link more soon after answer available requests do document article wanted"
).split()
# Words around the messages: titles, links, reference numbers, waiting times.
AROUND = "docs home contact team report problem skip tab ref edge incident few minutes seconds right now come again later soon".split()
GERMAN = (
    "aktivieren anmelden ansicht anzeige aufgetreten bitte das der dienst die diese dieser ein eine erlaubt erlauben erneut erreichbar es fehler für "
    "gefunden hier ist javascript konnte lässt laden müssen nicht ohne platzhaltertext seite server sehen sich sie skripte skript später steht text "
    "um und unerwarteter verfügbar versuchen verweigert vorübergehend werden wurde zugriff zum zur startseite blindtext"
).split()
FRENCH = (
    "accès accueil activer activez afficher autoriser autorisés cette dans de des doivent est être erreur il inattendue indisponible introuvable l "
    "la le les lecteur momentanément n'est navigateur ouvrir pas page plus pour pouvez refusé remplissage retour réessayez s scripts serveur "
    "service survenue temporairement texte trouvée une veuillez votre à d l'accueil javascript"
).split()
SPANISH = (
    "acceso abrir activar active ahora al con de del denegado disponible el en encontrada error esta está este ha habilite hay inesperado inicio "
    "javascript la los más navegador no para permitir por producido página que relleno se scripts servicio servidor su texto ver visor volver "
    "inténtelo tarde momento"
).split()
KNOWN = frozenset(ENGLISH + AROUND + GERMAN + FRENCH + SPANISH)

# What names the matter of a message, in words of a template: '#' is a number.
_S = r"(?:javascript|java-script|js|scripts?|scripting|script execution|skripte?)"
SCRIPT_CUES = [
    rf"(?:turn|switch) on {_S}", rf"(?:enable|allow|activate|active|activar|activer|activez|aktivieren|habilite|permitir)(?: \S+){{0,3}} {_S}",
    rf"{_S}(?: \S+){{0,4}} (?:disabled|switched off|turned off|required|needed|allowed|autorisés|erlaubt|aktivieren)",
    rf"(?:requires|need|needs)(?: \S+){{0,2}} {_S}", rf"(?:not|does not) support {_S}", rf"(?:ohne|sans|sin) {_S}",
    r"verifying that you are human", r"checking your browser",
]
ERROR_CUES = [
    r"(?:http|error)(?: #)+", r"^(?:# )*(?:not found|bad request|unauthorized|forbidden|request timeout|gone|too many requests|internal server error|bad gateway|service unavailable|gateway timeout)\b",
    r"(?:not found|bad request|unauthorized|forbidden|request timeout|gone|too many requests|internal server error|bad gateway|service unavailable|gateway timeout)(?: #)*$",
    r"(?:is|are) (?:temporarily )?(?:not available|unavailable|gone|overloaded|down|busy|no longer valid|missing)", r"(?:could not|cannot|can not) be (?:found|located|displayed|open|opened)",
    r"does not exist", r"has moved", r"was removed", r"(?:took|has taken) too long", r"unexpected (?:condition|error)", r"unusable reply", r"nothing lives at",
    r"something (?:broke|went wrong)", r"back shortly", r"permission to", r"(?:access|request)(?: \S+){0,4} (?:refused|denied|forbidden)", r"session has expired",
    r"nicht (?:gefunden|erreichbar|verfügbar)", r"zugriff verweigert", r"unerwarteter fehler", r"introuvable", r"accès refusé", r"indisponible", r"erreur inattendue",
    r"no encontrada", r"acceso denegado", r"no (?:está )?disponible", r"error inesperado", r"no longer valid",
]
FILLER_CUES = [
    r"^description to follow$", r"^content coming soon$", r"^your (?:content|text) here$", r"^(?:dummy|sample|placeholder) (?:text|copy|paragraph|content)\b", r"^text goes here$",
    r"^texto de relleno$", r"^texte de remplissage$", r"^hier steht später der text$", r"^(?:platzhaltertext|blindtext)\b", r"^replace me$",
]
FURNITURE = frozenset(
    "try again|go back to the start page|home docs contact|home|docs|contact|skip to content|loading|reload the tab afterwards|this may take a few seconds|report this problem|the viewer team"
    "|zur startseite|volver al inicio|retour à l'accueil|oops|request id #|request id *|incident #|ref * at edge *|ref # at edge *|try again later|#|* # # #|* docs".split("|")
)
CUES = frozenset(
    "javascript java-script js script scripts scripting skripte skript human browser http error found request unauthorized forbidden gone server gateway service available unavailable overloaded down "
    "busy valid missing located displayed exist moved removed long condition reply lives broke wrong shortly permission refused denied expired gefunden erreichbar verfügbar verweigert fehler introuvable "
    "refusé indisponible inattendue encontrada denegado disponible inesperado description content text dummy sample placeholder texto texte platzhaltertext blindtext replace".split()
)

# Mock Latin of filler texts; fixed values.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua nisi nulla vitae velit ornare congue lacus metus quis blandit "
    "semper mollis justo morbi dictum pharetra felis tellus turpis leo porta fusce arcu ligula cursus varius viverra augue sapien rhoncus".split()
)
# How a slot that was not filled looks; fixed values.
SLOTS = re.compile(
    r"\{\{[^{}\n]*\}\}|\$\{[^{}\n]*\}|\{\$\w[^{}\n]*\}|<%.*?%>|\{%.*?%\}|%\(\w+\)[sdfr]|#\{[^{}\n]*\}|%[A-Z][A-Z0-9_]+%|@@\w+@@|\[(?:INSERT|Insert|insert) [^\]\n]*\]"
    r"|<your [^<>\n]*>|<<\w[^<>\n]*>>|\[[^\[\]\n]* goes here\]|\[object [A-Za-z]+\]|(?<![{$#%\w])\{[a-z][a-z_]*\}(?!\})|\b__[A-Z][A-Z0-9_]*__\b"
)

_fence = re.compile(r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)")
_inline = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_tag = re.compile(r"</?(?:html|head|body|title|h[1-6]|p|div|span|noscript|br|hr|center|a|b|i|ul|li)\b[^<>]*>", re.I)
_cut = re.compile(r"(?<=[.!?…])\s+|\s*[\r\n]+\s*|\s+[-–—|·]\s+")
_word = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_script, _error, _fill = (re.compile("|".join(f"(?:{c})" for c in x)) for x in (SCRIPT_CUES, ERROR_CUES, FILLER_CUES))
_para = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)+")

#: Words of content that an error page or a notice may have beside its messages.
CONTENT_WORDS = 10
#: Messages are short; a longer line is content.
MESSAGE_WORDS = 40
#: Stands where code was cut out of a line.
CODE = "\ufffc"
#: Depth of the prefix tree below the number of words.
DEPTH = 3
#: Share of the positions in which a message agrees with a template of its leaf to be merged with it.
ALIKE = 0.6
#: Different texts that have a mined template, and the share of them in which it stands alone.
TEXTS = 5
ALONE = 0.9


def _shape(words: list[str]) -> list[str]:
    return ["#" if w.isdigit() else w if w in KNOWN else "*" for w in words]


def cue(text: str) -> str | None:
    """What a wording is about by its cues: 'script', 'error' or nothing."""
    return "script" if _script.search(text) else "error" if _error.search(text) else None


def leaf(message: str) -> str:
    """Where the prefix tree keeps a message: number of words, then the first ones."""
    words = message.split(" ")
    return " ".join([str(len(words)), *_shape(words[:DEPTH])])


def merge(messages: list[str]) -> list[str]:
    """The template of each message of a leaf. All have the same number of words; a message
    joins the template that agrees with it in most positions, and those that differ become wildcards."""
    templates: list[list[str]] = []
    own = []
    for m in messages:
        words = m.split(" ")
        best, most = -1, ALIKE * len(words)
        for k, t in enumerate(templates):
            same = sum(map(str.__eq__, t, words))
            if same > most or same == most and best < 0:
                best, most = k, same
        if best < 0:
            templates.append(words)
            best = len(templates) - 1
        else:
            templates[best] = [x if x == y else "*" for x, y in zip(templates[best], words)]
        own.append(best)
    return [" ".join(templates[k]) for k in own]


def mined(template: str) -> str | None:
    """Verdict of a mined template: its cue, if it is in what does not vary and little varies."""
    words = template.split(" ")
    open_ = words.count("*")
    return cue(" ".join(w for w in words if w != "*")) if open_ <= 3 and 2 * open_ <= len(words) else None


def classify(template: str) -> str:
    """error, script, filler, furniture or content."""
    words = template.split(" ")
    if template in FURNITURE:
        return "furniture"
    unknown = words.count("*")
    text = " ".join(w for w in words if w != "*") if unknown else template
    if unknown == 0 and any(re.search(c, template) for c in FILLER_CUES):
        return "filler"
    if unknown <= 3 and 2 * unknown <= len(words):
        return cue(text) or "content"
    return "content"


def _periodic(words: list[str]) -> bool:
    """One unit of up to six words, four times or more, and nothing else."""
    n = len(words)
    for p in range(1, min(6, n // 4) + 1):
        if words[p:] == words[: n - p]:
            return True
    return False


def filler(text: str) -> bool:
    for p in _para.split(text):
        words = _word.findall(p.lower())
        if len(words) >= 4 and _periodic(words):
            return True
        # mock Latin may stand in a paragraph of its own or end one
        run = 0
        for w in words:
            run = run + 1 if w in LATIN else 0
            if run >= 6:
                return True
        if words and len(words) < 6 and all(w in LATIN for w in words) and len(words) >= 3:
            return True
    return False


def prose(text: str) -> tuple[str, int]:
    """The text without code, and the words of the code."""
    if "`" not in text and "~~~" not in text:
        return text, 0
    cut = 0

    def out(by: str):
        def f(m):
            nonlocal cut
            cut += len(_word.findall(m.group()))
            return by

        return f

    return _inline.sub(out(f" {CODE} "), _fence.sub(out("\n"), text)), cut


def bare(paragraph: str) -> str | None:
    """The shape of a notice that is a paragraph of its own, known word for word: neither heading, list, quote nor pseudo-heading."""
    paragraph = paragraph.strip()
    words = _word.findall(paragraph.lower())
    if not words or len(words) > MESSAGE_WORDS or CUES.isdisjoint(words) or CODE in paragraph or not (paragraph[0].isalnum() or paragraph[0] in "¡¿"):
        return None
    if paragraph[-1] not in ".!…" and len(words) < 4:
        return None
    hit = None
    for seg in _cut.split(paragraph):
        shape = " ".join(_shape(_word.findall(seg.lower())))
        kind = classify(shape) if shape else "furniture"
        if kind == "content" or "*" in shape and kind != "furniture":
            return None
        hit = shape if kind in ("error", "script") else hit
    return hit


def evidence(text: str) -> tuple[bool, bool, str | None, list[tuple[str, int, str | None]], int]:
    """(slots, filler, shape of a notice in a paragraph of its own, shapes of possible messages with their words of content and, where a cue
    stands among words of its own, the message itself, other words of content)."""
    plain, rest = prose(text)
    slot = SLOTS.search(plain) is not None
    mock = filler(plain)
    found = []
    if "<" in plain:
        plain = _tag.sub("\n", plain)
    own, before = None, ""
    for p in _para.split(plain):
        # what a colon announces is quoted
        own = own or (None if before.endswith(":") else bare(p))
        before = p.rstrip() or before
    for seg in _cut.split(plain):
        if not seg:
            continue
        # code within a line is a word of its own
        words = _word.findall(seg.lower().replace(CODE, "codecutout") if CODE in seg else seg.lower())
        if not words:
            continue
        if len(words) > MESSAGE_WORDS or (CUES.isdisjoint(words) and not any(w.isdigit() for w in words) and "again" not in words and "to" not in words and len(words) > 4):
            rest += len(words)
            continue
        shape = _shape(words)
        n, message = shape.count("*"), None
        if n and not CUES.isdisjoint(words):
            message = " ".join("#" if w.isdigit() else "*" if w == "codecutout" else w for w in words)
            message = message if cue(message) else None
        found.append((" ".join(shape), n or 1, message))
    return slot, mock, own, found, rest


EVIDENCE = "doc_id bigint, row bigint, text bigint, template string, message string, words int, slot boolean, filler boolean, own boolean"


def _collect(frames):
    for f in frames:
        out = []
        for doc, row, text, key in f.itertuples(index=False):
            if not text or not text.strip():
                continue
            slot, mock, own, found, rest = evidence(text)
            if slot or mock or rest:
                out.append((doc, row, key, None, None, rest, slot, mock, False))
            if own:
                out.append((doc, row, key, own, None, 0, False, False, True))
            # other messages make no case of documents with much content, but show where a message stands
            few = rest <= CONTENT_WORDS
            for t, n, message in found:
                if few or message or _fill.search(t):
                    out.append((doc, row, key, t, message, n, False, False, False))
        yield pd.DataFrame(out, columns=["doc_id", "row", "text", "template", "message", "words", "slot", "filler", "own"])


def _verdicts(frames):
    for f in frames:
        yield pd.DataFrame({"template": f["template"], "verdict": [classify(t) for t in f["template"]]})


def _merged(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values(["n", "message"], ascending=[False, True])
    return pd.DataFrame({"message": f["message"], "mined": merge(f["message"].tolist())})


def _mined(frames):
    for f in frames:
        yield pd.DataFrame({"mined": f["mined"], "verdict": [mined(t) for t in f["mined"]]})


def mine(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """Messages that the corpus shows to be such: message, mined ('error' or 'script')."""
    content = F.when(F.col("verdict") == "content", F.col("words")).otherwise(0)
    open_ = parts.filter("message is not null and verdict = 'content'").groupBy("row", "message").agg(F.min("text").alias("text"), F.sum("words").alias("own"))
    open_ = scratch.keep(open_, "messages")
    per = parts.join(open_.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.sum(content).alias("content"))
    at = open_.join(per, "row").select("message", "text", (F.col("content") - F.col("own") <= CONTENT_WORDS).alias("alone"))
    counts = open_.groupBy("message").agg(F.count("*").alias("n"))
    counts = counts.withColumn("leaf", F.pandas_udf(lambda m: m.map(leaf), "string")("message"))
    merged = scratch.keep(counts.groupBy("leaf").applyInPandas(_merged, "message string, mined string"), "merged")
    # copies of a text count once
    per_text = at.join(merged, "message").groupBy("mined", "text").agg(F.max("alone").cast("int").alias("alone"))
    support = per_text.groupBy("mined").agg(F.count("*").alias("texts"), F.avg("alone").alias("alone"))
    good = support.filter((F.col("texts") >= TEXTS) & (F.col("alone") >= ALONE)).select("mined").mapInPandas(_mined, "mined string, verdict string")
    return merged.join(good.filter("verdict is not null"), "mined").select("message", F.col("verdict").alias("mined"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that are residue: doc_id, reason ('slot', 'filler', 'error' or 'script')."""
    scratch = Scratch(docs.sparkSession, "residue")
    rows = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    ev = scratch.keep(rows.mapInPandas(_collect, EVIDENCE), "evidence")
    templates = ev.filter("template is not null").select("template").distinct()
    verdicts = templates.mapInPandas(_verdicts, "template string, verdict string")
    parts = ev.join(verdicts, "template", "left").withColumn("verdict", F.coalesce("verdict", F.lit("content")))
    parts = scratch.keep(parts.drop("template"), "parts")
    parts = parts.join(mine(parts, scratch), "message", "left")
    parts = parts.withColumn("verdict", F.when(F.col("verdict") == "content", F.coalesce("mined", "verdict")).otherwise(F.col("verdict")))
    content = F.when(F.col("verdict") == "content", F.col("words")).otherwise(0)
    has = lambda v: F.max(F.col("verdict") == v)
    per = parts.groupBy("doc_id", "row").agg(
        F.sum(content).alias("content"), F.max("slot").alias("slot"), (F.max("filler") | has("filler")).alias("filler"),
        has("error").alias("error"), has("script").alias("script"), F.max("own").alias("own"),
    )
    # each row is judged by itself; an id has what any of its rows has
    short = (F.col("content") <= CONTENT_WORDS) | F.col("own")
    per = per.groupBy("doc_id").agg(F.max("slot").alias("slot"), F.max("filler").alias("filler"), F.max(F.col("script") & short).alias("script"), F.max(F.col("error") & short).alias("error"))
    reason = (
        F.when(F.col("slot"), "slot").when(F.col("filler"), "filler")
        .when(F.col("script"), "script").when(F.col("error"), "error")
    )
    return per.select("doc_id", reason.alias("reason")).filter("reason is not null")


def p10_found(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents")).select("doc_id")


def p10_clean(spark, sf_dir: str) -> DataFrame:
    """The corpus without residue."""
    docs = load(spark, sf_dir, "documents")
    return docs.join(judge(docs).select("doc_id"), "doc_id", "left_anti")


def p10_reasons(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return judge(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "reason").agg(F.count("*").alias("docs"))
