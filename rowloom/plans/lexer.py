"""Tokens of a program text: kinds, byte offsets and literal values.

One pattern over the UTF-8 bytes; each alternative is a token class. Offsets count bytes, comments are tokens, and the
last token is always Eof.
"""

from __future__ import annotations

import re
from decimal import Decimal
from functools import partial
from itertools import accumulate
from operator import add
from typing import NamedTuple

#: Symbols and their kinds.
SYMBOLS = {
    "+": "Plus", "-": "Minus", "*": "Star", "/": "Slash", "=": "Equals", "<": "LessThan", ">": "GreaterThan",
    "<=": "LessThanOrEqual", ">=": "GreaterThanOrEqual", "<>": "NotEqual", "+=": "PlusEquals", "-=": "MinusEquals",
    "*=": "StarEquals", "/=": "SlashEquals", ":": "Colon", "::": "DoubleColon", ".": "Period", "?": "Question",
    "[": "LeftBracket", "]": "RightBracket", "{": "LeftBrace", "}": "RightBrace", "(": "LeftParen", ")": "RightParen", ",": "Comma",
}

#: The token classes, one after another, over a source whose characters stand for its bytes.
_CLASSES = r"""
   (?:[Nn][Oo]|[Ss][Hh][Aa][Rr][Ee]|[Ee][Xx][Cc][Ll][Uu][Ss][Ii][Vv][Ee])[ \t]+[Ll][Oo][Cc][Kk](?![A-Za-z0-9_-])
  |[A-Za-z_][A-Za-z0-9_-]*
  |[=<>?.:()\[\],}*+-](?:(?<=[-+*<>])=|(?<=<)>|(?<=:):)?
  |[0-9]+(?:\.[0-9]+)?
  |"(?:[^"~]|~.)*"|'(?:[^'~]|~.)*'|["'].*
  |//[^\n]*\n?|/\*.*?\*/|/\*.*|/=?
  |\{&[^}]*\}?|&[A-Za-z0-9-]*|\{
  |[\xc0-\xff][\x80-\xbf]*|."""
_TOKEN = re.compile(_CLASSES, re.X | re.S)
#: A part is a token and the blanks after it: parts follow each other without a gap, so sums of their lengths are offsets.
_PARTS = re.compile(f"(?:{_CLASSES})[ \\t\\n\\r]*", re.X | re.S)
_LEAD = re.compile("[ \\t\\n\\r]*")
_STRING = re.compile(r""""(?:[^"~]|~.)*"|'(?:[^'~]|~.)*'""", re.S)

_LOCKS = {"no": "NoLock", "share": "ShareLock", "exclusive": "ExclusiveLock"}
_BOOLEANS = {"KwTrue": True, "KwFalse": False}


class Token(NamedTuple):
    """kind, start and end in bytes, text, value (int, Decimal, str, bool or None)."""

    kind: str
    start: int
    end: int
    text: str
    value: object = None


class _Seen(dict):
    """(kind, text, value, bytes of the text) by part, told once for each different part."""

    #: Parts that are remembered at most.
    MOST = 1 << 18

    def __init__(self, keywords: dict[str, str]):
        super().__init__()
        self.known = keywords.get

    def __missing__(self, part: str) -> tuple:
        raw = _TOKEN.match(part)[0]
        found = (*self._told(raw if raw.isascii() else raw.encode("latin-1").decode("utf-8", "surrogatepass")), len(raw))
        if len(part) <= 64:
            if len(self) >= self.MOST:
                self.clear()
            self[part] = found
        return found

    def _told(self, text: str) -> tuple:
        c = text[0]
        if c.isascii() and (c.isalpha() or c == "_"):
            if " " in text or "\t" in text:
                return _LOCKS[text.split()[0].lower()], text, None
            kind = self.known(text.lower(), "Identifier")
            return kind, text, _BOOLEANS.get(kind)
        if c in "0123456789":
            if "." in text:
                return "DecimalLiteral", text, Decimal(text)
            n = int(text) if len(text) < 20 else 1 << 63
            return ("IntegerLiteral", text, None) if n >= 1 << 63 else ("IntegerLiteral" if n < 1 << 31 else "BigIntLiteral", text, n)
        if c in "\"'":
            return ("StringLiteral", text, text[1:-1]) if _STRING.fullmatch(text) else ("Invalid", text, None)
        if text.startswith("//") or text.startswith("/*"):
            return "Comment" if c + text[1] == "//" or (text.endswith("*/") and len(text) > 3) else "Invalid", text, None
        if text.startswith("{&"):
            return self.known(text.lower(), "Preprop"), text, None
        if c == "&":
            return self.known(text.lower(), "Invalid"), text, None
        return SYMBOLS.get(text, "Invalid"), text, None


_LEXERS: dict[int, tuple[dict, _Seen]] = {}
_new = partial(tuple.__new__, Token)


def _seen(keywords: dict[str, str] | None) -> _Seen:
    if keywords is None:
        from rowloom.operators.keywords import builtin_spellings

        keywords = builtin_spellings()
    held = _LEXERS.get(id(keywords))
    if held is None or held[0] is not keywords:
        if len(_LEXERS) > 8:
            _LEXERS.clear()
        held = _LEXERS[id(keywords)] = (keywords, _Seen(keywords))
    return held[1]


def columns(source: str, keywords: dict[str, str] | None = None) -> tuple[tuple, list[int], list[int], tuple, tuple]:
    """Kinds, starts, ends, texts and values of the tokens of a source, without the Eof, each column as one sequence.

    One pass of the pattern cuts the parts, sums of their lengths are the offsets, and what a part is is looked up; no
    step is taken token by token in Python but for parts not seen before.
    """
    raw = source if source.isascii() else source.encode("utf-8", "surrogatepass").decode("latin-1")
    lead = _LEAD.match(raw).end()
    parts = _PARTS.findall(raw, lead)
    if not parts:
        return (), [], [], (), ()
    kinds, texts, values, sizes = zip(*map(_seen(keywords).__getitem__, parts))
    starts = list(accumulate(map(len, parts), initial=lead))
    del starts[-1]
    return kinds, starts, list(map(add, starts, sizes)), texts, values


def tokenize(source: str, keywords: dict[str, str] | None = None) -> list[Token]:
    """All tokens of a source. keywords: kind by lower-case spelling (see operators.keywords); default: the built-in ones."""
    kinds, starts, ends, texts, values = columns(source, keywords)
    out = list(map(_new, zip(kinds, starts, ends, texts, values)))
    size = len(source) if source.isascii() else len(source.encode("utf-8", "surrogatepass"))
    out.append(Token("Eof", size, size, ""))
    return out


def unescaped(text: str) -> str:
    """A string literal's value: tilde escapes resolved."""
    return re.sub(r"~(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text, flags=re.S)


class LineMap:
    """Byte offset to (line, column), both from 1; only a line feed starts a line; columns count bytes."""

    def __init__(self, source: str):
        raw = source.encode("utf-8", "surrogatepass")
        self.starts = [0] + [i + 1 for i, b in enumerate(raw) if b == 10]

    def lookup(self, offset: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1
