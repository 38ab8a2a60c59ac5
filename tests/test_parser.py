import pytest

from rowloom.plans import syntax as S
from rowloom.plans.parser import ParseError, parse, parse_expression

N, L, B = S.Name, S.Literal, S.Binary


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3", B("+", L(1), B("*", L(2), L(3)))),
        ("(1 + 2) * 3", B("*", B("+", L(1), L(2)), L(3))),
        ("10 - 4 - 3", B("-", B("-", L(10), L(4)), L(3))),
        ("a or b and c", B("or", N("a"), B("and", N("b"), N("c")))),
        ("not a = b", B("=", S.Unary("not", N("a")), N("b"))),
        ("- x mod 2", B("mod", S.Unary("-", N("x")), L(2))),
        ("a EQ 1", B("=", N("a"), L(1))),
        ("n begins 'A'", B("begins", N("n"), L("A"))),
        ("if a then 1 else if b then 2 else 3", S.Choice(N("a"), L(1), S.Choice(N("b"), L(2), L(3)))),
        ("f(1, g())", S.Call("f", (L(1), S.Call("g", ())))),
        ("m[1][2]", S.Index(S.Index(N("m"), L(1)), L(2))),
        ("obj:name", S.Member(N("obj"), "name")),
        ("obj:go(1):on", S.Member(S.Member(N("obj"), "go", (L(1),)), "on")),
        ("db.t.f", S.Field("db.t", "f")),
        ("events.value", S.Field("events", "value")),
        ("documents.text", S.Field("documents", "text")),
        ("embeddings.label", S.Field("embeddings", "label")),
        ("x = ?", B("=", N("x"), S.Unknown())),
        ("3000000000", L(3000000000)),
        ("yes", L(True)),
        ("'it~'s'", L("it's")),
        ("x between 1 and 2", B("and", B(">=", N("x"), L(1)), B("<=", N("x"), L(2)))),
    ],
)
def test_expressions(text, want):
    assert parse_expression(text) == want


def test_a_dot_with_a_blank_ends_the_statement():
    assert parse("x = y. z = 1.") == [S.Assign(N("x"), N("y")), S.Assign(N("z"), L(1))]


def test_a_colon_with_a_blank_opens_the_block():
    (loop,) = parse("FOR EACH o WHERE o.k = c.k: t = t + 1. END.")
    assert loop.where == B("=", S.Field("o", "k"), S.Field("c", "k")) and loop.body == [S.Assign(N("t"), B("+", N("t"), L(1)))]


def test_comments_are_dropped():
    assert parse("/* a */ x = 1. // b\n") == [S.Assign(N("x"), L(1))]


def test_statements():
    text = """
    DEFINE VARIABLE a AS INTEGER NO-UNDO INITIAL 3. VAR CHAR b = 'x'. DEF VAR c AS DECIMAL EXTENT 4.
    DEFINE INPUT-OUTPUT PARAMETER p AS LOGICAL.
    DO i = 1 TO 10 BY 2: END. DO WHILE a < 3: LEAVE. END DO. REPEAT: NEXT. END REPEAT. DO: . END.
    IF a = 1 THEN b = 'y'. ELSE DO: b = 'z'. END.
    FIND FIRST t WHERE t.k = 1 NO-LOCK NO-ERROR. FIND t 5. FIND NEXT t. FIND LAST t OF u EXCLUSIVE-LOCK.
    CASE a: WHEN 1 OR WHEN 2 THEN RETURN a. OTHERWISE RETURN. END CASE.
    PROCEDURE q: END PROCEDURE. RUN q (INPUT 1, OUTPUT a). RUN VALUE(b). RUN dir/file.p.
    """
    kinds = [type(s).__name__ for s in parse(text)]
    assert kinds == ["Declare"] * 3 + ["Parameter", "Do", "Do", "Repeat", "Do", "If"] + ["Find"] * 4 + ["Case", "Procedure", "Run", "Run", "Run"]
    finds = [s for s in parse(text) if isinstance(s, S.Find)]
    assert [(f.which, f.no_error, f.lock) for f in finds] == [("first", True, "NoLock"), ("unique", False, "ShareLock"), ("next", False, "ShareLock"), ("last", False, "ExclusiveLock")]
    assert parse(text)[-1].target == L("dir/file.p")


def test_a_run_name_ends_at_its_period():
    assert [type(s).__name__ for s in parse("RUN a. b = 1.")] == ["Run", "Assign"]


def test_comparison_as_statement():
    assert parse("x EQ y.") == [S.Evaluate(B("=", N("x"), N("y")))]


@pytest.mark.parametrize("text", ["x = .", "FOR orders: END.", "FOR EACH o:", "DEFINE VARIABLE a AS nothing.", "a < b < c.", "IF a THEN", "x = 99999999999999999999."])
def test_errors_name_their_place(text):
    with pytest.raises(ParseError, match=r"line \d+, column \d+"):
        parse(text)
