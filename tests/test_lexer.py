import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.plans.lexer import LineMap, tokenize, unescaped


def kinds(text):
    return [t.kind for t in tokenize(text)][:-1]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("42.foo", ["IntegerLiteral", "Period", "Identifier"]),
        ("123.456", ["DecimalLiteral"]),
        ("3000000000", ["BigIntLiteral"]),
        ("x += 1", ["Identifier", "PlusEquals", "IntegerLiteral"]),
        ("a <> b <= c >= d", ["Identifier", "NotEqual", "Identifier", "LessThanOrEqual", "Identifier", "GreaterThanOrEqual", "Identifier"]),
        ("A::m", ["Identifier", "DoubleColon", "Identifier"]),
        ("my-var1 a-b", ["Identifier", "Identifier"]),
        ("NO LOCK", ["NoLock"]),
        ("NO    LOCK", ["NoLock"]),
        ("share\tlock", ["ShareLock"]),
        ("NO\nLOCK", ["Identifier", "Identifier"]),
        ("exclusive locks", ["Identifier", "Identifier"]),
        ("no-lock exclusive-lock", ["NoLock", "ExclusiveLock"]),
        ("def defi define", ["Define"] * 3),
        ("'one' \"two\"", ["StringLiteral"] * 2),
        ("'open", ["Invalid"]),
        ("'tail~", ["Invalid"]),
        ("/* a * b */ c", ["Comment", "Identifier"]),
        ("/* open", ["Invalid"]),
        ("a // b\nc", ["Identifier", "Comment", "Identifier"]),
        ("{&name} &if &nothing", ["Preprop", "PreprocIf", "Invalid"]),
        ("{ }", ["LeftBrace", "RightBrace"]),
        ("é", ["Invalid"]),
        ("true FALSE", ["KwTrue", "KwFalse"]),
        ("+ add", ["Plus", "Identifier"]),
    ],
)
def test_kinds(text, want):
    assert kinds(text) == want


def test_values_and_byte_offsets():
    found = tokenize("é 'a~'b' 7 true")
    assert [(t.start, t.end) for t in found] == [(0, 2), (3, 9), (10, 11), (12, 16), (16, 16)]
    assert [t.value for t in found] == [None, "a~'b", 7, True, None]
    assert unescaped("a~'b~n") == "a'b\n"


def test_line_comment_holds_its_line_end():
    assert [(t.kind, t.start, t.end) for t in tokenize("//x\ny")][:2] == [("Comment", 0, 4), ("Identifier", 4, 5)]


@pytest.mark.parametrize(
    ("text", "offset", "want"),
    [("", 0, (1, 1)), ("ab\ncd", 3, (2, 1)), ("ab\n", 3, (2, 1)), ("a\r\nb", 1, (1, 2)), ("a\r\nb", 3, (2, 1)), ("héllo\nworld", 3, (1, 4)), ("héllo\nworld", 7, (2, 1))],
)
def test_line_map(text, offset, want):
    assert LineMap(text).lookup(offset) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ09_-.,:;'\"~/*{}&+<>=? \n\té😀", max_size=60))
def test_tokens_tile_the_text(text):
    raw = text.encode()
    found = tokenize(text)
    at = 0
    for t in found:
        assert raw[at : t.start].strip(b" \t\r\n") == b""
        assert raw[t.start : t.end].decode() == t.text
        at = t.end
    assert at == len(raw) and found[-1].kind == "Eof"
