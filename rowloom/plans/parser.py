"""Program text to syntax trees: statements by their first word, expressions by binding powers.

A dot or colon joins names only where it touches both. Comments are dropped. The first error ends parsing, with its line
and column. NOT binds tighter than a comparison; a comparison takes one operator at most.
"""

from __future__ import annotations

from rowloom.plans import syntax as S
from rowloom.plans.lexer import LineMap, Token, tokenize, unescaped


class ParseError(ValueError):
    """Message with line and column."""


#: Type words by the type they name.
TYPES = {
    "integer": "integer", "int": "integer", "int64": "int64", "decimal": "decimal", "dec": "decimal", "character": "character", "char": "character",
    "logical": "logical", "log": "logical", "date": "date", "datetime": "datetime", "datetime-tz": "datetime-tz", "handle": "handle", "rowid": "rowid",
    "recid": "recid", "raw": "raw", "memptr": "memptr", "longchar": "longchar", "clob": "clob", "blob": "blob", "com-handle": "com-handle",
}

#: Comparison words and symbols by one name.
COMPARE = {"=": "=", "eq": "=", "<>": "<>", "ne": "<>", "<": "<", "lt": "<", "<=": "<=", "le": "<=", ">": ">", "gt": ">", ">=": ">=", "ge": ">=", "begins": "begins", "matches": "matches", "contains": "contains", "like": "like"}

_CLAUSES = {"where", "of", "by", "break", "no-lock", "share-lock", "exclusive-lock", "no-error", "use-index", "no-wait", "no-prefetch"}
_LOCKS = {"no-lock": "NoLock", "share-lock": "ShareLock", "exclusive-lock": "ExclusiveLock"}
_KIND_LOCKS = {"NoLock", "ShareLock", "ExclusiveLock"}
_COMPOUND = {"+=": "+", "-=": "-", "*=": "*", "/=": "/"}


class Parser:
    def __init__(self, source: str):
        self.tokens: list[Token] = [t for t in tokenize(source) if t.kind != "Comment"]
        self.lines, self.at = LineMap(source), 0

    # -- cursor
    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def word(self, ahead: int = 0) -> str:
        """Lower-case text of a word or symbol ahead; literals give an empty text."""
        t = self.peek(ahead)
        if t.kind in _KIND_LOCKS:
            return {"NoLock": "no-lock", "ShareLock": "share-lock", "ExclusiveLock": "exclusive-lock"}[t.kind]
        return "" if t.kind.endswith("Literal") else t.text.lower()

    def take(self) -> Token:
        t = self.peek()
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return t

    def accept(self, *words: str) -> bool:
        if self.word() in words and self.peek().kind != "Eof":
            self.take()
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            self.fail(f"expected {' or '.join(words)}")

    def fail(self, message: str):
        t = self.peek()
        line, column = self.lines.lookup(t.start)
        raise ParseError(f"line {line}, column {column}: {message}, found {t.text or 'end of text'!r}")

    def is_name(self, ahead: int = 0) -> bool:
        text = self.peek(ahead).text
        return bool(text) and (text[0].isalpha() or text[0] == "_") and not self.peek(ahead).kind.endswith("Literal")

    def name(self) -> str:
        if not self.is_name():
            self.fail("expected a name")
        return self.take().text

    def touches(self, ahead: int = 0) -> bool:
        """Whether the token ahead touches its neighbours on both sides."""
        i = self.at + ahead
        return 0 < i < len(self.tokens) - 1 and self.tokens[i - 1].end == self.tokens[i].start and self.tokens[i].end == self.tokens[i + 1].start

    # -- expressions
    def expression(self):
        if self.word() == "if":
            self.take()
            cond = self.disjunction()
            self.expect("then")
            yes = self.expression()
            self.expect("else")
            return S.Choice(cond, yes, self.expression())
        return self.disjunction()

    def disjunction(self):
        left = self.conjunction()
        while self.accept("or"):
            left = S.Binary("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.accept("and"):
            left = S.Binary("and", left, self.comparison())
        return left

    def comparison(self):
        left = self.sum()
        op = COMPARE.get(self.word())
        if op:
            self.take()
            return S.Binary(op, left, self.sum())
        if self.accept("is"):
            op = "<>" if self.accept("not") else "="
            self.expect("null", "unknown")
            return S.Binary(op, left, S.Unknown())
        if self.accept("in"):
            values = self.arguments()
            return S.Call("in", (left, *values))
        if self.accept("between"):
            low = self.sum()
            self.expect("and")
            return S.Binary("and", S.Binary(">=", left, low), S.Binary("<=", left, self.sum()))
        return left

    def sum(self):
        left = self.product()
        while self.word() in ("+", "-"):
            left = S.Binary(self.take().text, left, self.product())
        return left

    def product(self):
        left = self.unary()
        while self.word() in ("*", "/", "mod", "modulo"):
            op = self.take().text.lower()
            left = S.Binary("mod" if op.startswith("mod") else op, left, self.unary())
        return left

    def unary(self):
        if self.word() in ("-", "not"):
            return S.Unary(self.take().text.lower(), self.unary())
        return self.postfix()

    def postfix(self):
        value = self.primary()
        while True:
            if self.word() == "[":
                self.take()
                index = self.expression()
                self.expect("]")
                value = S.Index(value, index)
            elif self.word() == ":" and self.touches() and self.is_name(1):
                self.take()
                name = self.name()
                value = S.Member(value, name, self.arguments() if self.word() == "(" else None)
            else:
                return value

    def arguments(self) -> tuple:
        self.expect("(")
        args = []
        while self.word() != ")":
            args.append(self.expression())
            if not self.accept(","):
                break
        self.expect(")")
        return tuple(args)

    def primary(self):
        t = self.peek()
        if t.kind in ("IntegerLiteral", "BigIntLiteral", "DecimalLiteral"):
            if t.value is None:
                self.fail("number out of range")
            return S.Literal(self.take().value)
        if t.kind == "StringLiteral":
            return S.Literal(unescaped(self.take().value))
        if self.accept("("):
            inner = self.expression()
            self.expect(")")
            return inner
        if self.accept("?"):
            return S.Unknown()
        if self.word() in ("true", "yes", "false", "no") and self.peek(1).text != "(":
            return S.Literal(self.take().text.lower() in ("true", "yes"))
        if self.word() == "can-find":
            self.take()
            self.expect("(")
            find = self.find_clauses()
            self.expect(")")
            return S.CanFind(find)
        if self.word() == "accum":
            self.take()
            kind = self.name().lower()
            return S.Call("accum", (S.Literal(kind), self.postfix()))
        if self.word() in ("available", "avail", "ambiguous") and self.is_name(1):
            word = self.take().text.lower()
            return S.Call("ambiguous" if word == "ambiguous" else "available", (S.Name(self.name()),))
        if not self.is_name():
            self.fail("expected an expression")
        name = self.take().text
        if self.word() == "(":
            return S.Call(name.lower(), self.arguments())
        parts = [name]
        while self.word() == "." and self.touches() and self.is_name(1):
            self.take()
            parts.append(self.take().text)
        return S.Name(name) if len(parts) == 1 else S.Field(".".join(parts[:-1]), parts[-1])

    # -- statements
    def program(self) -> list:
        out = []
        while self.peek().kind != "Eof":
            out.append(self.statement())
        return out

    def statement(self):
        word = self.word()
        if self.accept("."):
            return S.Empty()
        nxt = self.peek(1).text
        assigns = nxt == "=" or nxt in _COMPOUND or nxt == "[" or (nxt == "." and self.tokens[min(self.at + 1, len(self.tokens) - 1)].start == self.peek().end and self.is_name(2) and self.peek(2).start == self.peek(1).end)
        rule = None if assigns else getattr(self, "_" + {"def": "define", "for": "for_each", "disp": "display", "if": "if_statement", "return": "return_statement", "accum": "accumulate"}.get(word, word).replace("-", "_"), None)
        if rule and word in _STATEMENTS:
            self.take()
            return rule()
        return self.simple()

    def simple(self):
        target = self.postfix()
        op = self.word()
        if op == "=" and isinstance(target, (S.Name, S.Field, S.Index)):
            self.take()
            value = self.expression()
            self.expect(".")
            return S.Assign(target, value)
        if op in _COMPOUND:
            self.take()
            value = S.Binary(_COMPOUND[op], target, self.expression())
            self.expect(".")
            return S.Assign(target, value)
        if op in COMPARE:
            self.take()
            target = S.Binary(COMPARE[op], target, self.sum())
        self.expect(".")
        return S.Evaluate(target)

    def block(self, *closers: str) -> list:
        """Statements up to END and its optional word."""
        out = []
        while not (self.word() == "end" and self.peek(1).text != "="):
            if self.peek().kind == "Eof":
                self.fail("expected end")
            out.append(self.statement())
        self.take()
        self.accept(*closers)
        self.expect(".")
        return out

    def one_or_block(self) -> list:
        return [self.statement()]

    def type_name(self) -> str:
        found = TYPES.get(self.word())
        if not found:
            self.fail("unknown data type")
        self.take()
        return found

    def _define(self):
        if self.word() in ("input", "output", "input-output"):
            direction = self.take().text.lower()
            self.expect("parameter", "param")
            name = self.name()
            self.expect("as")
            kind = self.type_name()
            self.accept("no-undo")
            self.expect(".")
            return S.Parameter(direction, name, kind)
        self.accept("new")
        self.accept("shared", "private", "public", "protected")
        if self.accept("temp-table", "work-table", "workfile"):
            return self.temp_table()
        if self.accept("buffer"):
            out = S.BufferFor(self.name(), self.after("for"))
            self.expect(".")
            return out
        if self.accept("dataset"):
            return self.dataset()
        self.expect("variable", "var")
        name = self.name()
        self.expect("as")
        out = S.Declare(name, self.type_name())
        while self.word() != ".":
            if self.accept("no-undo"):
                out.no_undo = True
            elif self.accept("initial", "init"):
                out.initial = self.listed() if self.word() == "[" else self.expression()
            elif self.accept("extent"):
                out.extent = self.take().value if self.peek().kind == "IntegerLiteral" else 0
            else:
                self.fail("expected no-undo, initial, extent or a period")
        self.expect(".")
        return out

    def after(self, word: str) -> str:
        self.expect(word)
        return self.name()

    def temp_table(self):
        """DEFINE TEMP-TABLE: fields by type or LIKE a table; the primary index is the table's order."""
        out, order, primary = S.TempTable(self.name(), []), [], False
        while self.word() != ".":
            if self.accept("no-undo", "rcode-information"):
                continue
            if self.accept("like"):
                out.like = self.name()
            elif self.accept("field"):
                name = self.name()
                self.expect("as")
                out.fields.append((name, self.type_name()))
                while self.word() not in (".", "field", "index"):
                    if self.accept("initial", "init"):
                        self.listed() if self.word() == "[" else self.expression()
                    elif self.accept("label", "column-label", "format", "help"):
                        self.take()
                    else:
                        self.fail("expected a field option")
            elif self.accept("index"):
                self.name()
                main, columns = False, []
                if self.accept("is", "as"):
                    while self.word() in ("primary", "unique", "word-index"):
                        main = self.take().text.lower() == "primary" or main
                while self.is_name() and self.word() not in ("index", "field"):
                    columns.append(self.name())
                    self.accept("ascending", "descending", "asc", "desc")
                if (main and not primary) or not order:
                    order, primary = columns, main
            else:
                self.fail("expected field, index, like or a period")
        self.expect(".")
        out.order = tuple(order)
        return out

    def dataset(self):
        """DEFINE DATASET d FOR a, b DATA-RELATION r FOR a, b RELATION-FIELDS (x, y): pairs of parent and child fields."""
        out = S.DataSet(self.name(), [self.after("for")], [])
        while self.accept(","):
            out.tables.append(self.name())
        while self.accept("data-relation"):
            if self.word() != "for":
                self.name()
            parent = self.after("for")
            self.expect(",")
            child, pairs = self.name(), []
            self.expect("relation-fields")
            self.expect("(")
            while self.word() != ")":
                mine = self.name()
                self.expect(",")
                pairs.append((mine, self.name()))
                self.accept(",")
            self.expect(")")
            out.relations.append((parent, child, tuple(pairs)))
        self.expect(".")
        return out

    def record_name(self, kind):
        out = kind(self.name())
        self.accept("no-error")
        self.expect(".")
        return out

    def _create(self):
        return self.record_name(S.Create)

    def _delete(self):
        return self.record_name(S.Delete)

    def _release(self):
        return self.record_name(S.Release)

    def _empty(self):
        self.expect("temp-table")
        return self.record_name(S.EmptyTable)

    def _function(self):
        """FUNCTION f RETURNS type (parameters): body END FUNCTION."""
        name, params = self.name(), []
        self.expect("returns")
        kind = self.type_name()
        if self.accept("("):
            while self.word() != ")":
                self.accept("input")
                own = self.name()
                self.expect("as")
                params.append(S.Parameter("input", own, self.type_name()))
                self.accept(",")
            self.expect(")")
        self.expect(":")
        return S.Function(name, kind, params, self.block("function"))

    def _select(self):
        """A query: its tokens up to the period that ends it, INTO and its variables apart."""
        out = S.Select([], [])
        while self.word() != "." or (self.touches() and self.is_name(1)):
            if self.peek().kind == "Eof":
                self.fail("expected a period")
            if self.accept("into"):
                out.into.append(self.name())
                while self.accept(","):
                    out.into.append(self.name())
                continue
            out.tokens.append(self.take())
        self.expect(".")
        return out

    def stream(self, direction: str, word: str):
        if self.accept("close"):
            path = None
        else:
            self.expect(word)
            path = self.expression()
        while self.word() != ".":
            self.take()
        self.expect(".")
        return S.Stream(direction, path)

    def _input(self):
        return self.stream("input", "from")

    def _output(self):
        return self.stream("output", "to")

    def delimiter(self) -> str:
        return self.take().value if self.accept("delimiter") else " "

    def _export(self):
        delimiter, items = self.delimiter(), []
        while self.word() != ".":
            items.append((self.expression(), None, None))
        self.expect(".")
        return S.Export(items, delimiter)

    _put = _export

    def _import(self):
        out = S.Import("", self.delimiter())
        out.buffer = self.name()
        self.expect(".")
        return out

    def _undo(self):
        leave = True
        if self.accept(","):
            leave = self.take().text.lower() != "next"
        self.expect(".")
        return S.Undo(leave)

    def listed(self) -> tuple:
        self.expect("[")
        out = [self.expression()]
        while self.accept(","):
            out.append(self.expression())
        self.expect("]")
        return tuple(out)

    def _var(self):
        kind = self.type_name()
        out = S.Declare(self.name(), kind, no_undo=True)
        if self.accept("="):
            out.initial = self.expression()
        self.expect(".")
        return out

    def _assign(self):
        pairs = []
        while self.word() != ".":
            target = self.postfix()
            self.expect("=")
            pairs.append(S.Assign(target, self.expression()))
        self.expect(".")
        return pairs[0] if len(pairs) == 1 else S.If(S.Literal(True), pairs)

    def _do(self):
        out = S.Do([])
        if self.is_name() and self.peek(1).text == "=":
            out.var = self.name()
            self.take()
            out.start = self.expression()
            self.expect("to")
            out.stop = self.expression()
            if self.accept("by"):
                out.step = self.expression()
        if self.accept("while"):
            out.cond = self.expression()
        undone = self.accept("transaction")
        while self.accept("on"):
            self.name()
            self.expect("undo")
            undone = True
            if self.accept(","):
                self.name()
        self.expect(":")
        if not undone or out.var or out.cond:
            out.body = self.block("do")
            return out
        return self.transaction()

    def transaction(self):
        """A body with CATCH e AS type: ... END CATCH. and FINALLY: ... END FINALLY. before its end."""
        out = S.Transaction([])
        while not (self.word() == "end" and self.peek(1).text != "="):
            if self.peek().kind == "Eof":
                self.fail("expected end")
            if self.accept("catch"):
                while self.word() != ":":
                    self.take()
                self.take()
                out.catches.append(self.block("catch"))
            elif self.accept("finally"):
                self.expect(":")
                out.finally_ = self.block("finally")
            else:
                out.body.append(self.statement())
        self.take()
        self.accept("do")
        self.expect(".")
        return out

    def _repeat(self):
        cond = self.expression() if self.accept("while") else None
        self.expect(":")
        return S.Repeat(self.block("repeat"), cond)

    def _if_statement(self):
        cond = self.expression()
        self.expect("then")
        yes = self.one_or_block()
        no = self.one_or_block() if self.accept("else") else []
        return S.If(cond, yes, no)

    def _case(self):
        value = self.expression()
        self.expect(":")
        branches, otherwise = [], []
        while self.word() != "end":
            if self.accept("otherwise"):
                otherwise = self.one_or_block()
                continue
            self.expect("when")
            values = [self.sum()]
            while self.accept("or"):
                self.accept("when")
                values.append(self.sum())
            self.expect("then")
            branches.append((values, self.one_or_block()))
        self.take()
        self.accept("case")
        self.expect(".")
        return S.Case(value, branches, otherwise)

    def _for_each(self):
        which = self.take().text.lower()
        if which not in ("each", "first", "last"):
            self.fail("expected each, first or last")
        out = self.record(S.ForEach(self.name(), [], which=which))
        nest = [out]
        while self.accept(","):
            kind = self.take().text.lower()
            nest.append(self.record(S.ForEach(self.name(), [], which=kind)))
        if self.accept("break"):
            nest[0].breaks = True
        while self.accept("by"):
            key = self.sum()
            down = self.accept("descending", "desc")
            if not down:
                self.accept("ascending", "asc")
            nest[0].by.append((key, down))
        if self.accept("skip"):
            nest[0].skip = self.take().value
        self.expect(":")
        nest[-1].body = self.block("for")
        for outer, inner in zip(nest, nest[1:]):
            outer.body = [inner]
        return out

    def record(self, out):
        while True:
            word = self.word()
            if word == "of":
                self.take()
                out.of = self.name()
            elif word == "where":
                self.take()
                out.where = self.expression()
            elif word in _LOCKS:
                self.take()
                out.lock = _LOCKS[word]
            elif word == "use-index":
                self.take()
                self.name()
            elif word in ("no-wait", "no-prefetch"):
                self.take()
            elif word == "no-error" and isinstance(out, S.Find):
                self.take()
                out.no_error = True
            else:
                return out

    def find_clauses(self) -> S.Find:
        which = self.take().text.lower() if self.word() in ("first", "last", "next", "prev", "current") and self.is_name(1) else "unique"
        out = S.Find(self.name(), which)
        if self.word() not in _CLAUSES and self.word() not in (".", ")", ","):
            out.key = self.sum()
        return self.record(out)

    def _find(self):
        out = self.find_clauses()
        self.expect(".")
        return out

    def _procedure(self):
        name = self.name()
        self.expect(":")
        return S.Procedure(name, self.block("procedure"))

    def _run(self):
        if self.accept("value"):
            self.expect("(")
            target = self.expression()
            self.expect(")")
        else:
            parts = [self.take().text]
            while self.word() in (".", "/", "-") and self.touches():
                parts += [self.take().text, self.take().text]
            target = S.Literal("".join(parts).strip("\"'"))
        args = []
        if self.accept("("):
            while self.word() != ")":
                direction = self.take().text.lower() if self.word() in ("input", "output", "input-output") else "input"
                args.append((direction, self.expression()))
                if not self.accept(","):
                    break
            self.expect(")")
        self.accept("no-error")
        self.expect(".")
        return S.Run(target, args)

    def expression_before_list(self):
        """An expression whose last name is followed by the list of aggregates."""
        depth, end, last = 0, self.at, self.at
        while self.tokens[end].text != ".":
            if self.tokens[end].text == "(":
                depth, last = depth + 1, end if depth == 0 else last
            elif self.tokens[end].text == ")":
                depth -= 1
            elif self.tokens[end].kind == "Eof":
                self.fail("expected a list of aggregates")
            end += 1
            if depth == 0 and self.tokens[end].text == "." and self.tokens[end - 1].text == ")":
                break
        head, self.tokens = self.tokens, [*self.tokens[:last], Token("Eof", self.tokens[last].start, self.tokens[last].start, "")]
        value = self.expression()
        self.tokens = head
        return value

    def _leave(self):
        self.expect(".")
        return S.Leave()

    def _next(self):
        self.expect(".")
        return S.Next()

    def _return_statement(self):
        value = None if self.word() == "." else self.expression()
        self.expect(".")
        return S.Return(value)

    def _display(self):
        items, besides = [], ()
        while self.word() != ".":
            if self.accept("except"):
                besides = []
                while self.word() not in (".", "with"):
                    besides.append(self.postfix())
                continue
            if self.accept("skip"):  # where a screen begins a line
                if self.word() == "(":
                    self.arguments()
                continue
            if self.accept("with"):  # how a screen frames it
                while self.word() != ".":
                    self.take()
                continue
            value, label, form = self.expression(), None, None
            while self.word() in ("label", "column-label", "format"):
                if self.take().text.lower() == "format":
                    form = unescaped(self.take().value)
                else:
                    label = unescaped(self.take().value)
            items.append((value, label, form))
        self.expect(".")
        return S.Display(items, tuple(besides))

    def _message(self):
        """MESSAGE: its expressions as a row; how it would be shown is passed over."""
        items = []
        while self.word() not in (".", "view-as"):
            items.append((self.expression(), None, None))
        while self.word() != ".":
            self.take()
        self.expect(".")
        return S.Display(items)

    def _accumulate(self):
        simple = self.is_name() and self.peek(1).text == "("  # a name here isn't a call: the parenthesis lists the aggregates
        value = S.Name(self.name()) if simple else self.expression_before_list()
        self.expect("(")
        kinds = []
        while self.word() != ")":
            kinds.append(self.name().lower())
        self.expect(")")
        self.expect(".")
        return S.Accumulate(value, kinds)


_STATEMENTS = {"define", "def", "var", "assign", "do", "repeat", "if", "case", "for", "find", "procedure", "run", "leave", "next", "return", "display", "disp", "message", "accumulate", "accum", "create", "delete", "release", "empty", "function", "select", "input", "output", "export", "put", "import", "undo"}


def parse(source: str) -> list:
    """The statements of a program."""
    return Parser(source).program()


def parse_expression(source: str):
    p = Parser(source)
    out = p.expression()
    if p.peek().kind != "Eof":
        p.fail("expected the end")
    return out
