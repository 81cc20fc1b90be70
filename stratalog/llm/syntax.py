"""Syntax trees of source files, as far as functions and their documentation go.

Python files go through the interpreter's own parser. For Rust, TypeScript and
Go a lexer marks off comments, strings and words, brackets are matched, and a
recursive descent over the items builds a tree of types and functions. Code in
strings, comments and macros is no item. A function is a ``Def`` with the span
of its source, its signature and the documentation attached to it.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, field


@dataclass
class Def:
    name: str
    types: tuple[str, ...]
    start: int
    end: int
    head: tuple[int, int]
    doc: str | None = None
    params: list[str] = field(default_factory=list)


@dataclass
class Tok:
    kind: str  # word, punct, string, number, line, block
    text: str
    start: int
    end: int


_LEX = {
    "rust": r"""(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<h>\#*)"(?s:.*?)"(?P=h))|(?P<string>b?"(?:\\(?s:.)|[^"\\])*")"""
    r"""|(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^\\'\n])')|(?P<life>'[A-Za-z_]\w*)|(?P<word>(?:r\#)?[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<punct>\S)""",
    "typescript": r"""(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<string>"(?:\\(?s:.)|[^"\\\n])*"|'(?:\\(?s:.)|[^'\\\n])*')|(?P<tick>`)"""
    r"""|(?P<word>\#?[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<arrow>=>)|(?P<punct>\S)""",
    "go": r"""(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<string>"(?:\\.|[^"\\\n])*"|`[^`]*`)|(?P<char>'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<punct>\S)""",
}
_LEX = {k: re.compile(v) for k, v in _LEX.items()}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_NEST = re.compile(r"/\*|\*/")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def _block_end(src: str, at: int, nested: bool) -> int:
    if not nested:
        k = src.find("*/", at + 2)
        return len(src) if k < 0 else k + 2
    depth = 0
    for m in _NEST.finditer(src, at):
        depth += 1 if m.group() == "/*" else -1
        if depth == 0:
            return m.end()
    return len(src)


def _tick_end(src: str, at: int) -> int:
    """End of a template literal; expressions inside may hold further ones."""
    i, n = at + 1, len(src)
    while i < n:
        c = src[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and src.startswith("${", i):
            depth, i = 1, i + 2
            while i < n and depth:
                c = src[i]
                if c == "`":
                    i = _tick_end(src, i)
                    continue
                if c in "\"'":
                    m = _LEX["typescript"].match(src, i)
                    if m and m.lastgroup == "string":
                        i = m.end()
                        continue
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    return n


def lex(src: str, lang: str) -> list[Tok]:
    out, at, find = [], 0, _LEX[lang].search
    last = None
    while m := find(src, at):
        kind, s, e = m.lastgroup, m.start(), m.end()
        if kind == "h":
            kind = "raw"
        if kind == "block":
            e = _block_end(src, s, lang == "rust")
        elif kind == "tick":
            e, kind = _tick_end(src, s), "string"
        elif kind == "punct" and m.group() == "/" and lang == "typescript":
            # a slash begins a pattern where no value can end before it
            if last is None or (last.kind == "punct" and last.text not in ")]}") or last.text in ("return", "typeof", "case", "=>"):
                if r := _REGEX.match(src, s):
                    e, kind = r.end(), "string"
        kind = {"raw": "string", "char": "string", "life": "punct", "arrow": "punct"}.get(kind, kind)
        t = Tok(kind, src[s:e], s, e)
        out.append(t)
        if kind not in ("line", "block"):
            last = t
        at = max(e, s + 1)
    return out


def match_brackets(toks: list[Tok]) -> dict[int, int]:
    """Index of the closing bracket of each opening one; what is never closed runs to the end."""
    pairs, stack = {}, []
    for i, t in enumerate(toks):
        if t.kind != "punct":
            continue
        if t.text in _OPEN:
            stack.append(i)
        elif t.text in _CLOSE:
            while stack:
                j = stack.pop()
                if _OPEN[toks[j].text] == t.text:
                    pairs[j] = i
                    break
                pairs[j] = i
    for j in stack:
        pairs[j] = len(toks)
    return pairs


class _Reader:
    """Descends through the items of one file."""

    KEEP: frozenset = frozenset()

    def __init__(self, src: str, lang: str):
        self.src, self.toks = src, lex(src, lang)
        self.close = match_brackets(self.toks)
        self.found: list[Def] = []

    def text(self, i: int) -> str:
        return self.toks[i].text if i < len(self.toks) else ""

    def word(self, i: int) -> bool:
        return i < len(self.toks) and self.toks[i].kind == "word"

    def next_code(self, i: int) -> int:
        while i < len(self.toks) and self.toks[i].kind in ("line", "block"):
            i += 1
        return i

    def to_body(self, i: int, stop: tuple = (";",)) -> tuple[int, bool]:
        """Index of the next ``{`` outside of round and square brackets, or of a stop before it."""
        while i < len(self.toks):
            t = self.toks[i]
            if t.kind == "punct":
                if t.text == "{":
                    return i, True
                if t.text in stop or t.text == "}":
                    return i, False
                if t.text in "([":
                    i = self.close[i]
            i += 1
        return len(self.toks), False

    def span_end(self, i: int) -> int:
        return self.toks[i].end if i < len(self.toks) else len(self.src)

    def param_names(self, i: int, end: int) -> list[str]:
        """First word of each entry of the first round brackets in ``i..end``."""
        while i < end and self.text(i) != "(":
            i += 1
        names, fresh, k = [], True, i + 1
        stop = self.close.get(i, i)
        while k < min(stop, len(self.toks)):
            t = self.toks[k]
            if t.kind == "punct" and t.text in _OPEN:
                k = self.close[k]
            elif t.kind == "punct" and t.text == ",":
                fresh = True
            elif t.kind == "word" and fresh and t.text not in ("mut", "self", "ref"):
                names.append(t.text)
                fresh = False
            k += 1
        return names

    def add(self, name: str, types: tuple, first: int, i: int, body: int, has_body: bool, doc: str | None) -> int:
        """Notes a function and reads its body; returns the index after it."""
        end = self.close.get(body, body) if has_body else body
        head_end = self.toks[body].start if body < len(self.toks) else len(self.src)
        d = Def(name, types, self.toks[first].start, self.span_end(end), (self.toks[first].start, head_end), doc)
        d.params = self.param_names(i, body)
        self.found.append(d)
        if has_body:
            self.items(body + 1, min(end, len(self.toks)), types)
        return end + 1

    def items(self, i: int, end: int, types: tuple) -> None:
        raise NotImplementedError


def strip_marks(comment: str) -> str:
    """A comment without its marks: slashes, stars at the line starts, the closing mark."""
    if comment.startswith("/*"):
        body = re.sub(r"\*+/$", "", re.sub(r"^/\*+!?", "", comment))
        return "\n".join(re.sub(r"^\s*\*+(?!\*)", "", x) if k else x for k, x in enumerate(re.split(r"\r\n|\r|\n", body)))
    return re.sub(r"^//+!?", "", comment)


def _unquote(s: str) -> str:
    m = re.match(r'b?r(#*)"(.*)"\1$', s, re.S)
    if m:
        return m.group(2)
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), m.group(1)), s.strip()[1:-1], flags=re.S)


class _Rust(_Reader):
    MODIFIERS = frozenset(("pub", "async", "const", "unsafe", "extern", "default"))

    def type_name(self, i: int, end: int) -> str:
        """Name of the type of an impl: the last path word before generics, after a ``for`` if there is one."""
        depth, name, last = 0, "", ""
        k = i
        while k < end:
            t = self.toks[k]
            if t.text == "<":
                depth += 1
            elif t.text == ">" and self.text(k - 1) not in ("-", "="):
                depth -= 1
            elif depth == 0 and t.kind == "word":
                if t.text == "where":
                    break
                if t.text == "for" and self.text(k + 1) != "<":
                    name = ""
                elif t.text not in ("dyn", "mut", "const", "for", "unsafe"):
                    name = t.text
            last = t.text
            k += 1
        return name.removeprefix("r#")

    def items(self, i: int, end: int, types: tuple) -> None:
        docs, first = [], None

        def reset():
            nonlocal first
            docs.clear()
            first = None

        while i < end:
            t = self.toks[i]
            if t.kind == "line":
                if t.text.startswith("///") and not t.text.startswith("////"):
                    docs.append(strip_marks(t.text.rstrip("\r")))
                i += 1
                continue
            if t.kind == "block":
                if t.text.startswith("/**") and not t.text.startswith("/***") and len(t.text) > 4:
                    docs.append(strip_marks(t.text))
                i += 1
                continue
            if t.text == "#" and t.kind == "punct":
                k = i + 1 + (self.text(i + 1) == "!")
                if self.text(k) == "[":
                    if k == i + 1 and self.text(k + 1) == "doc" and self.text(k + 2) == "=" and self.toks[k + 3].kind == "string":
                        docs.append(_unquote(self.toks[k + 3].text))
                    i = self.close[k] + 1
                    continue
            if t.kind == "word":
                if first is None:
                    first = i
                if t.text in self.MODIFIERS:
                    i += 1
                    if t.text == "pub" and self.text(i) == "(":
                        i = self.close[i] + 1
                    if t.text == "extern" and i < end and self.toks[i].kind == "string":
                        i += 1
                    continue
                if t.text == "fn" and self.word(i + 1):
                    body, has = self.to_body(i + 2)
                    i = self.add(self.text(i + 1).removeprefix("r#"), types, first, i + 2, body, has, "\n".join(docs) if docs else None)
                    reset()
                    continue
                if t.text == "impl" and first is not None:
                    body, has = self.to_body(i + 1)
                    k = i + 1
                    if has:
                        self.items(body + 1, self.close[body], (*types, self.type_name(k, body)))
                        body = self.close[body]
                    i = body + 1
                    reset()
                    continue
                if t.text in ("trait", "mod") and self.word(i + 1):
                    body, has = self.to_body(i + 2)
                    if has:
                        self.items(body + 1, self.close[body], (*types, self.text(i + 1)) if t.text == "trait" else types)
                        body = self.close[body]
                    i = body + 1
                    reset()
                    continue
                if t.text in ("struct", "enum", "union") and self.word(i + 1):
                    body, has = self.to_body(i + 2)
                    i = (self.close[body] if has else body) + 1
                    reset()
                    continue
                if self.text(i + 1) == "!":  # a macro: what is in it is no item yet
                    k = i + 2 + self.word(i + 2)
                    if self.text(k) in _OPEN:
                        i = self.close[k] + 1
                        reset()
                        continue
            reset()
            i += 1


class _TypeScript(_Reader):
    MODIFIERS = frozenset(
        ("export", "default", "async", "declare", "abstract", "public", "private", "protected", "static", "readonly", "override", "get", "set", "accessor")
    )

    def doc_of(self, t: Tok) -> bool:
        return t.kind == "block" and t.text.startswith("/**") and len(t.text) > 4

    def decorator(self, i: int) -> int:
        i += 2
        while self.text(i) == "." and self.word(i + 1):
            i += 2
        return self.close[i] + 1 if self.text(i) == "(" else i

    def items(self, i: int, end: int, types: tuple, top: bool | None = None) -> None:
        doc, first = None, None
        top = not types and top is not False
        while i < end:
            t = self.toks[i]
            if t.kind in ("line", "block"):
                if self.doc_of(t):
                    doc, first = strip_marks(t.text), None
                i += 1
                continue
            if t.text == "@" and self.word(i + 1):
                first = i if first is None else first
                i = self.decorator(i)
                continue
            if t.kind == "word":
                first = i if first is None else first
                if t.text in self.MODIFIERS and (self.word(i + 1) or self.text(i + 1) in "@{*"):
                    i += 1
                    continue
                if t.text == "function":
                    k = i + 1 + (self.text(i + 1) == "*")
                    if self.word(k):
                        body, has = self.to_body_after(k + 1)
                        i = self.function(self.text(k), types, first, k + 1, body, has, doc)
                        doc = first = None
                        continue
                if t.text == "class" and self.word(i + 1):
                    body, has = self.to_body(i + 2)
                    if has:
                        self.members(body + 1, self.close[body], (*types, self.text(i + 1)))
                        body = self.close[body]
                    i, doc, first = body + 1, None, None
                    continue
                if t.text in ("namespace", "module") and self.word(i + 1):
                    body, has = self.to_body(i + 2)
                    if has:
                        self.items(body + 1, self.close[body], types, top)
                        body = self.close[body]
                    i, doc, first = body + 1, None, None
                    continue
                if t.text in ("interface", "enum") and self.word(i + 1):
                    body, has = self.to_body(i + 2)
                    i, doc, first = (self.close[body] if has else body) + 1, None, None
                    continue
                if t.text in ("const", "let", "var") and self.word(i + 1) and t.text == "const" and top:
                    arrow = self.arrow(i + 2, end)
                    if arrow is not None:
                        params, body, has = arrow
                        i = self.function(self.text(i + 1), types, first, params, body, has, doc)
                        doc = first = None
                        continue
            if t.text == "{" and t.kind == "punct":
                self.items(i + 1, min(self.close[i], end), types, False)
                i = self.close[i]
            doc = first = None
            i += 1

    def function(self, name, types, first, i, body, has, doc) -> int:
        end = self.close.get(body, body) if has else body
        head_end = self.toks[body].start if body < len(self.toks) else len(self.src)
        d = Def(name, types, self.toks[first].start, self.span_end(end), (self.toks[first].start, head_end), doc)
        d.params = self.param_names(i, body)
        self.found.append(d)
        if has:
            self.items(body + 1, min(end, len(self.toks)), types, False)
        return end + 1

    def to_body_after(self, i: int) -> tuple[int, bool]:
        """The body after parameters; braces of a returned object type come before it."""
        while i < len(self.toks) and self.text(i) != "(":
            i += 1
        i = self.close.get(i, i) + 1
        if self.text(i) == ":":
            i += 1
            while self.text(i) == "{":
                i = self.close[i] + 1
                if self.text(i) not in ("|", "&"):
                    break
                i += 1
        line = self.toks[i - 1].end if i <= len(self.toks) else 0
        while i < len(self.toks):
            t = self.toks[i]
            if t.kind == "punct":
                if t.text == "{":
                    return i, True
                if t.text in (";", "}"):
                    return i, False
                if t.text in "([":
                    i = self.close[i]
            elif t.kind == "word" and t.text in ("function", "class", "export", "const", "let", "import") and "\n" in self.src[line : t.start]:
                return i - 1, False
            line = self.toks[i].end if i < len(self.toks) else line
            i += 1
        return len(self.toks), False

    def arrow(self, i: int, end: int):
        """(start of parameters, body, braces?) if an arrow function is assigned here."""
        while i < end and self.text(i) != "=":  # a type may stand before
            t = self.text(i)
            if t in (";", "}", ",") or self.word(i) and t in ("const", "let", "var", "function", "class"):
                return None
            i = self.close[i] + 1 if t in _OPEN else i + 1
        i = self.next_code(i + 1)
        if self.text(i) == "async":
            i += 1
        params = i
        if self.text(i) == "<":
            depth = 0
            while i < end:
                depth += (self.text(i) == "<") - (self.text(i) == ">")
                i += 1
                if depth == 0:
                    break
            params = i
        if self.text(i) == "(":
            i = self.close[i] + 1
            if self.text(i) == ":":
                i += 1
                while i < end and self.text(i) != "=>":
                    if self.text(i) in (";", "="):
                        return None
                    i = self.close[i] + 1 if self.text(i) in _OPEN else i + 1
        elif self.word(i):
            i += 1
        else:
            return None
        if self.text(i) != "=>":
            return None
        i = self.next_code(i + 1)
        if self.text(i) == "{":
            return params, i, True
        while i < end and self.text(i) != ";":
            if i + 1 < end and "\n" in self.src[self.toks[i].end : self.toks[i + 1].start] and self.text(i + 1) in ("export", "const", "function", "class"):
                break
            i = self.close[i] + 1 if self.text(i) in _OPEN else i + 1
        return params, min(i, end), False

    def members(self, i: int, end: int, types: tuple) -> None:
        doc, first = None, None
        while i < end:
            t = self.toks[i]
            if t.kind in ("line", "block"):
                if self.doc_of(t):
                    doc, first = strip_marks(t.text), None
                i += 1
                continue
            first = i if first is None else first
            if t.text == "@" and self.word(i + 1):
                i = self.decorator(i)
                continue
            if t.text == "*" or t.kind == "word" and t.text in self.MODIFIERS and self.text(i + 1) not in ("(", "=", ":", ";", "?", "!", "<"):
                i += 1
                continue
            if t.kind in ("word", "string", "number"):
                k = i + 1 + (self.text(i + 1) in ("?", "!"))
                if self.text(k) in ("(", "<"):
                    body, has = self.to_body_after(k)
                    i = self.function(t.text.strip("'\""), types, first, k, body, has, doc)
                    doc = first = None
                    continue
            # a property: up to its end, past whatever brackets its value has
            while i < end and self.text(i) != ";":
                i = self.close[i] if self.text(i) in _OPEN else i
                i += 1
                if i < end and "\n" in self.src[self.toks[i - 1].end : self.toks[i].start] and self.text(i - 1) not in ("=", "=>", ",", "+", "|", "&", ":", "?", "."):
                    i -= 1
                    break
            i, doc, first = i + 1, None, None


class _Go(_Reader):
    def comment_above(self, i: int) -> str | None:
        """The comment group that ends on the line above token ``i``, without directives."""
        k, at, lines = i - 1, self.toks[i].start, []
        while k >= 0 and self.toks[k].kind in ("line", "block"):
            gap = self.src[self.toks[k].end : at]
            if len(re.findall(r"\r\n|\r|\n", gap)) != 1 or gap.strip():
                break
            before = self.src[self.src.rfind("\n", 0, self.toks[k].start) + 1 : self.toks[k].start]
            if before.strip():  # the end of a line of code
                break
            lines.append(self.toks[k].text.rstrip("\r"))
            at = self.toks[k].start
            k -= 1
        lines = [x for x in reversed(lines) if not re.match(r"//(?:[a-z0-9]+:[a-z0-9]|line |extern |export )|/\*line ", x) and not re.match(r"//\s*\+build\b", x)]
        return "\n".join(map(strip_marks, lines)) if lines else None

    def items(self, i: int, end: int, types: tuple) -> None:
        while i < end:
            t = self.toks[i]
            if t.kind == "word" and t.text == "func" and not types:
                k, owner = i + 1, ()
                if self.text(k) == "(":
                    words = [x.text for x in self.toks[k + 1 : self.close[k]] if x.kind == "word" or x.text == "["]
                    if "[" in words:
                        words = words[: words.index("[")]
                    owner = (words[-1],) if words else ()
                    k = self.close[k] + 1
                if self.word(k):
                    body, has = self.go_body(k + 1)
                    end_ = self.close.get(body, body) if has else body
                    d = Def(self.text(k), owner, t.start, self.span_end(end_), (t.start, self.toks[body].start if body < len(self.toks) else len(self.src)))
                    d.doc = self.comment_above(i)
                    d.params = self.param_names(k + 1, body)
                    self.found.append(d)
                    i = end_ + 1
                    continue
            if t.kind == "punct" and t.text in _OPEN:
                i = self.close[i]
            i += 1

    def go_body(self, i: int) -> tuple[int, bool]:
        """The body's brace; those of interface and struct types in the results come before it."""
        while i < len(self.toks):
            t = self.toks[i]
            if t.kind == "punct":
                if t.text == "{":
                    if self.text(i - 1) in ("interface", "struct"):
                        i = self.close[i] + 1
                        continue
                    return i, True
                if t.text in "([":
                    i = self.close[i]
            elif t.kind == "word" and t.text in ("func", "type", "var", "const") and "\n" in self.src[self.toks[i - 1].end : t.start]:
                return i - 1, False
            i += 1
        return len(self.toks), False


#: Where statements hold other statements.
_BODIES = ("body", "orelse", "finalbody", "handlers", "cases")


def _tree(text: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def _python(src: str) -> tuple[list[Def], bool]:
    text = src.lstrip("\ufeff")
    shift = len(src) - len(text)
    try:
        return _python_defs(text, _tree(text), shift, ()), True
    except (SyntaxError, ValueError, RecursionError):
        # what can be read of a broken file
        return _python_pieces(text, shift, 0, ()), False


_head = re.compile(r"(?m)^([ \t]*)(?:@|def\b|async[ \t]+def\b|class[ \t]+(\w+))")


def _python_pieces(text: str, shift: int, indent: int, types: tuple[str, ...]) -> list[Def]:
    """The functions of the pieces at one indentation, each parsed by itself; a class that is refused is taken apart, too."""
    heads = [m for m in _head.finditer(text) if len(m.group(1)) == indent]
    starts, marks = [], []
    for k, m in enumerate(heads):
        # decorators belong to what follows
        if not (k and text[heads[k - 1].start() : heads[k - 1].end()].strip() == "@" and heads[k - 1].end() <= m.start() and not text[text.find("\n", heads[k - 1].end()) + 1 : m.start()].strip()):
            starts.append(m.start())
            marks.append(m)
        else:
            marks[-1] = m
    out = []
    for a, b, m in zip(starts, [*starts[1:], len(text)], marks):
        piece = text[a:b]
        front = "if 1:\n" if indent else ""
        try:
            out += _python_defs(front + piece, _tree(front + piece), shift + a - len(front), types)
        except (SyntaxError, ValueError, RecursionError):
            inner = [len(x.group(1)) for x in _head.finditer(piece, m.end() - a) if len(x.group(1)) > indent] if m.group(2) else []
            if inner:
                out += _python_pieces(piece[m.end() - a :], shift + m.end(), min(inner), (*types, m.group(2)))
    return out


def _python_defs(text: str, tree, shift: int, types: tuple[str, ...]) -> list[Def]:
    lines = [0]
    for x in re.finditer(r"\r\n|\r|\n", text):
        lines.append(x.end())

    def offset(line: int, col: int) -> int:
        a = lines[line - 1]
        b = lines[line] if line < len(lines) else len(text)
        part = text[a:b]
        return shift + a + (col if part.isascii() else len(part.encode("utf-8", "surrogatepass")[:col].decode("utf-8", "ignore")))

    found: list[Def] = []

    def visit(node, types):
        for name in _BODIES:
            for child in getattr(node, name, ()):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    a = offset(child.lineno, child.col_offset)
                    e = offset(child.end_lineno, child.end_col_offset)
                    body = child.body[0]
                    head = offset(body.lineno, body.col_offset)
                    g = child.args
                    d = Def(child.name, types, a, e, (a, head), ast.get_docstring(child, clean=False))
                    d.params = [x.arg for x in (*g.posonlyargs, *g.args, *g.kwonlyargs, g.vararg, g.kwarg) if x is not None]
                    found.append(d)
                    visit(child, types)
                elif isinstance(child, ast.ClassDef):
                    visit(child, (*types, child.name))
                else:
                    visit(child, types)

    visit(tree, types)
    return found


def read(src: str, lang: str) -> tuple[list[Def], bool]:
    """All functions and methods of a file, and whether it was read whole; an unknown language has none."""
    if lang == "python":
        return _python(src)
    reader = {"rust": _Rust, "typescript": _TypeScript, "go": _Go}.get(lang)
    if reader is None:
        return [], True
    r = reader(src, lang)
    r.items(0, len(r.toks), ())
    return sorted(r.found, key=lambda d: d.start), True


def definitions(src: str, lang: str) -> list[Def]:
    return read(src, lang)[0]
