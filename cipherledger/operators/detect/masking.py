"""Views of a source text without comments and with strings set apart, for languages of the C family."""

from __future__ import annotations

import re
from functools import lru_cache

_TOKEN = {
    "c": r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "go": r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`[^`]*`',
    "java": r'//[^\n]*|/\*.*?\*/|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "js": r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`',
}
_MASKERS = {k: re.compile(v, re.S) for k, v in _TOKEN.items()}
_BLANKS = re.compile(r"[^\n]")


def _blank(s: str) -> str:
    return " " * len(s) if "\n" not in s else _BLANKS.sub(" ", s)


def masked(text: str, lang: str) -> tuple[str, str]:
    """``(code, live)`` of the text's length: ``code`` has blanks for comments and for what is inside strings, ``live`` for
    comments only."""
    code, live, at, kept = [], [], 0, 0
    for m in _MASKERS[lang].finditer(text):
        t, start, end = m[0], m.start(), m.end()
        code.append(text[at:start])
        if t[:2] in ("//", "/*"):
            blank = _blank(t)
            code.append(blank)
            live += (text[kept:start], blank)
            kept = end
        else:
            code += (t[0], _blank(t[1:-1]), t[-1])
        at = end
    return "".join(code) + text[at:], "".join(live) + text[kept:]


_CHAIN = r"(?:new\s+)?[A-Za-z_$][\w$]*(?:\s*(?:\.|::|->)\s*[A-Za-z_$][\w$]*)*"
_PART = re.compile(rf"(?P<chain>{_CHAIN})|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<cut>,)|(?P<end>;|\n)|(?P<set>:=|(?<![=!<>+\-*/%&|^])=(?![=>]))")
_NEW, _SPACE, _TAKEN = re.compile(r"^new\s+"), re.compile(r"\s+"), re.compile(r"\s*(?:await\s+|&\s*|\(\s*[\w.<>]+\s*\)\s*)?")
_PAIR = {")": "(", "]": "[", "}": "{"}
_KEY = re.compile(r"""\s*(?:(["'])(?P<quoted>[^"'\n]*)\1|(?P<plain>[\w$]+))\s*:(?!:)\s*""")


class Span:
    """A bracket pair of a text: what it holds between its top-level commas, the name before it, and how it is used."""

    __slots__ = ("kind", "name", "at", "start", "end", "cuts", "inner", "target", "receiver", "_live", "_reads", "_properties", "_args")

    def __init__(self, kind, name, at, start, live, reads):
        self.kind, self.name, self.at, self.start, self._live = kind, name, at, start, live
        self._reads = reads  # the places of the text that rules looked at, of all brackets
        self.end, self.cuts, self.inner, self.target, self.receiver = len(live), [], [], None, None
        self._properties = self._args = None  # told once, when the whole text has been read

    def bounds(self) -> list[tuple[int, int]]:
        edges = [self.start, *(c + 1 for c in self.cuts)]
        return list(zip(edges, [*self.cuts, self.end]))

    @property
    def args(self) -> list[str]:
        """The texts between the commas, the last one only if there is something."""
        if self._args is None:
            self._reads.append((self.start, self.end))
            got = [self._live[a:b].strip() for a, b in self.bounds()]
            self._args = got if got[-1] else got[:-1]
        return self._args

    def arg(self, i: int) -> str | None:
        """The i-th of ``args``, the only one that is looked at."""
        if i > len(self.cuts):
            return None
        a, b = self.bounds()[i]
        self._reads.append((a, b))
        text = self._live[a:b].strip()
        return text if text or i < len(self.cuts) else None

    @property
    def first(self) -> str | None:
        """The string literal that is the first argument."""
        a, b = self.start, self.cuts[0] if self.cuts else self.end
        self._reads.append((a, b))
        return literal(self._live[a:b]) if b - a <= 400 else None

    def within(self, i: int, kind: str = "{") -> Span | None:
        """The first bracket of a kind that stands directly in the i-th argument."""
        if i >= len(self.cuts) + 1:
            return None
        a, b = self.bounds()[i]
        return next((x for x in self.inner if x.kind == kind and a <= x.start <= b), None)

    def properties(self) -> dict[str, tuple[str, Span | None]]:
        """Of an object: each key's value, as text and as the bracket that it is (or begins with)."""
        if self._properties is not None:
            return self._properties
        out = {}
        self._reads.append((self.start, self.end))
        for a, b in self.bounds():
            m = _KEY.match(self._live, a, b)
            if m:
                child = next((x for x in self.inner if m.end() <= x.start <= b), None)
                out.setdefault(m["quoted"] if m["plain"] is None else m["plain"], (self._live[m.end() : b].strip(), child))
        self._properties = out
        return out

    def prop(self, *path: str) -> str | None:
        """The text of a property, or of a property of a property."""
        at: Span | None = self
        text = None
        for key in path:
            if at is None or key not in (have := at.properties()):
                return None
            text, at = have[key]
        return text


@lru_cache(4096)
def _named(chain: str) -> str:
    """A chain of names as rules know it: without spaces, parts joined by points."""
    return _SPACE.sub("", _NEW.sub("new:", chain)).replace("::", ".").replace("->", ".")


_CHAINED, _OPENED, _CLOSED, _CUT, _END, _SET = (_PART.groupindex[k] for k in ("chain", "open", "close", "cut", "end", "set"))


def spans(code: str, live: str, reads: list[tuple[int, int]] | None = None) -> list[Span]:
    """All brackets of a text in the order of their starts, from one pass with a stack; its work is linear in the text. ``reads`` takes the
    places of the text that are looked at later, through the brackets' properties."""
    reads = [] if reads is None else reads
    out: list[Span] = []
    stack: list[Span] = []
    chain = closed = None  # the last name, the last bracket closed
    first = last = None  # names of the statement: before its first comma, and the last
    target = eq = None
    for m in _PART.finditer(code):
        kind, text = m.lastindex, m[0]
        if kind == _CHAINED:
            start, end = m.span()
            receiver = closed if closed and code[closed.end + 1 : start].strip() in (".", "?.", "->", "::") else None
            chain, last = (start, end, text, receiver), text
        elif kind == _OPENED:
            start, end = m.span()
            if chain and (chain[1] == start or not code[chain[1] : start].strip()):
                named = chain[2]
                span = Span(text, _named(named) if len(named) <= 200 else _named.__wrapped__(named), chain[0], end, live, reads)
                span.receiver = chain[3]
            else:
                span = Span(text, None, start, end, live, reads)
            if target and _TAKEN.fullmatch(code, eq, span.at):
                span.target = target
            elif span.receiver is not None:
                span.target = span.receiver.target  # a chain of calls
            if stack:
                stack[-1].inner.append(span)
            stack.append(span)
            out.append(span)
            chain = closed = None
            if text == "{":
                first = last = target = None
        elif kind == _CLOSED:
            start = m.start()
            while stack and stack[-1].kind != _PAIR[text]:
                stack.pop().end = start  # unbalanced text
            if stack:
                closed = stack.pop()
                closed.end = start
            chain = None
            if text == "}":
                first = last = target = None
        elif kind == _CUT:
            if stack:
                stack[-1].cuts.append(m.start())
            first = first or last
        elif kind == _SET:
            target, eq = (first or last), m.end()
            first = last = None
        else:
            if text == ";" or not (target and not code[eq : m.start()].strip()):
                target = None
            first = last = None
            chain = None if text == ";" else chain
    return out


def calls(code: str, live: str, limit: int = 20_000) -> list[Span]:
    """The brackets that are calls, with ``name``, ``args``, ``at``, ``target`` (the variable that takes the result) and
    ``receiver`` (the call whose result it is called on)."""
    return [x for x in spans(code, live) if x.kind == "(" and x.name][:limit]


_LITERAL = re.compile(r"""\s*(["'`])(.*?)\1\s*""", re.S)
_INTEGER, _OCTAL = re.compile(r"(?<![\w.])(0[xX][0-9a-fA-F]+|\d[\d_]*)(?![\w.])"), re.compile(r"0\d+")


def literal(arg: str | None) -> str | None:
    if arg is None:
        return None
    m = _LITERAL.fullmatch(arg)
    return m[2] if m else None


def integer(arg: str | None) -> int | None:
    if arg is None:
        return None
    m = _INTEGER.search(arg)
    return int(m[1].replace("_", ""), 0) if m and not _OCTAL.fullmatch(m[1]) else None
