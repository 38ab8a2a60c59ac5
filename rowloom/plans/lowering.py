"""Programs to DataFrames: record loops become scans, filters, joins, aggregates, windows and ordered limits.

Nothing is collected to run a loop. A loop body is executed once, symbolically, over the row: guards of IF, CASE and NEXT
become conditions, field assignments become columns, and updates of variables are recognised as sums, counts, extremes or
last values. A body that fits no pattern is rejected with LoweringError.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.functions import scalar
from rowloom.operators import records
from rowloom.plans import syntax as S
from rowloom.plans.catalog import Catalog
from rowloom.plans.lexer import unescaped
from rowloom.plans.parser import parse, parse_expression
from rowloom.sources import files

#: Spark types of the declared types that columns can have.
TYPES = {
    "integer": "int", "int64": "bigint", "decimal": "decimal(38,10)", "character": "string", "logical": "boolean", "date": "date", "datetime": "timestamp_ntz", "datetime-tz": "timestamp",
    "rowid": "bigint", "recid": "bigint", "raw": "binary", "memptr": "binary", "longchar": "string", "clob": "string", "blob": "binary",
}


class LoweringError(ValueError):
    """The program is well formed but has no plan."""


@dataclass
class Scalar:
    """A driver-side value."""

    value: object
    type: str | None = None


@dataclass
class Lazy:
    """A value that a one-row DataFrame holds in a column."""

    frame: DataFrame
    column: str


@dataclass
class Env:
    """What a program leaves: variables, and result DataFrames in order of their loops."""

    catalog: Catalog
    vars: dict[str, object] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    procedures: dict[str, S.Procedure] = field(default_factory=dict)
    rows: list[DataFrame] = field(default_factory=list)
    records: dict[str, DataFrame] = field(default_factory=dict)
    returned: object = None
    functions: dict[str, S.Function] = field(default_factory=dict)
    pending: dict[str, dict[str, str]] = field(default_factory=dict)  # buffer of a created record: field -> variable
    paths: dict[str, str] = field(default_factory=dict)  # open streams

    def value(self, *names: str) -> DataFrame:
        """One row with the named variables."""
        frame, cols, done = None, [], {}
        for n in names:
            v = self.vars[n.lower()]
            if isinstance(v, Lazy):
                if id(v.frame) not in done:
                    k = len(done)
                    done[id(v.frame)] = k
                    renamed = v.frame.select(*[F.col(c).alias(f"{c}__{k}") for c in v.frame.columns])
                    frame = renamed if frame is None else frame.crossJoin(renamed)
                cols.append(F.col(f"{v.column}__{done[id(v.frame)]}").alias(n))
            else:
                cols.append(_literal(v).alias(n))
        return (frame if frame is not None else self.catalog.spark.range(1)).select(*cols)


def _literal(v: Scalar) -> Column:
    x = v.value
    out = F.lit(x) if not isinstance(x, (list, tuple)) else F.array(*[F.lit(i) for i in x])
    return out.cast(TYPES[v.type]) if v.type in TYPES and not isinstance(x, (list, tuple)) else out


def like_pattern(pattern: str) -> str:
    """A MATCHES pattern as LIKE: star any run, dot one character, tilde escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern):
            i += 1
            c = pattern[i]
            out.append("\\" + c if c in "%_\\" else c)
        else:
            out.append({"*": "%", ".": "_"}.get(c, "\\" + c if c in "%_\\" else c))
        i += 1
    return "".join(out)


_COMPARES = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


class Scope:
    """Resolves names to columns: buffers from the innermost outward, then variables."""

    def __init__(self, env: Env):
        self.env = env
        self.buffers: dict[str, dict[str, str]] = {}  # buffer: field (lower case) -> column name in the rows
        self.fields: dict[tuple[str, str], Column] = {}  # assigned fields
        self.locals: dict[str, Column] = {}  # variables assigned in this iteration
        self.blocked: set[str] = set()  # variables that the loop carries
        self.outer: set[str] = set()  # buffers to be read as outer columns of a lateral join
        self.lazies: dict[str, Lazy] = {}  # variables to be joined as one row
        self.special: dict[tuple, Column] = {}

    def column(self, buffer: str, name: str) -> Column:
        got = self.fields.get((buffer, name.lower()))
        if got is not None:
            return got
        c = F.col(self.buffers[buffer][name.lower()])
        return c.outer() if buffer in self.outer else c

    def name(self, name: str) -> Column:
        low = name.lower()
        if low in self.locals:
            return self.locals[low]
        if low in self.blocked:
            raise LoweringError(f"{name} depends on earlier iterations in a way that has no plan")
        if low in self.env.vars:
            v = self.env.vars[low]
            if isinstance(v, Lazy):
                self.lazies[low] = v
                return F.col(f"__var_{low}")
            return _literal(v)
        for b in reversed(list(self.buffers)):
            if low in self.buffers[b]:
                return self.column(b, low)
        if low == "today":
            return F.current_date()
        if low == "now":
            return F.localtimestamp()
        if low in ("etime", "time", "mtime"):
            return scalar.call(low, [])
        raise LoweringError(f"unknown name {name}")

    def field(self, e: S.Field) -> Column:
        q = e.qualifier.split(".")[-1].lower()
        if q in self.buffers:
            if e.name.lower() not in self.buffers[q]:
                raise LoweringError(f"{e.qualifier} has no field {e.name}")
            return self.column(q, e.name)
        return self.name(e.qualifier).getField(e.name)

    def expr(self, e) -> Column:  # noqa: C901
        if isinstance(e, S.Literal):
            return F.lit(e.value)
        if isinstance(e, S.Unknown):
            return F.lit(None)
        if isinstance(e, S.Name):
            return self.name(e.name)
        if isinstance(e, S.Field):
            return self.field(e)
        if isinstance(e, S.Choice):
            return F.when(self.expr(e.cond), self.expr(e.yes)).otherwise(self.expr(e.no))
        if isinstance(e, S.Unary):
            return ~self.expr(e.value) if e.op == "not" else -self.expr(e.value)
        if isinstance(e, S.Index):
            return F.element_at(self.expr(e.value), self.expr(e.index).cast("int"))
        if isinstance(e, S.Member):
            if e.args is None:
                return self.expr(e.value).getField(e.name)
            return scalar.call(e.name, [self.expr(e.value), *map(self.expr, e.args)])
        if isinstance(e, S.Call):
            return self.call(e)
        if isinstance(e, S.Binary):
            return self.binary(e)
        raise LoweringError(f"{type(e).__name__} has no meaning here")

    def call(self, e: S.Call) -> Column:
        if ("call", e.name, e.args) in self.special:
            return self.special["call", e.name, e.args]
        if e.name in ("first-of", "last-of") and (e.name, e.args[0]) in self.special:
            return self.special[e.name, e.args[0]]
        if e.name == "in":
            return self.expr(e.args[0]).isin(*map(self.expr, e.args[1:]))
        if e.name == "ambiguous":  # whether the last FIND of a buffer met several rows
            return self.special.get(("ambiguous", e.args[0].name.lower()), F.lit(False))
        if e.name == "locked":  # a query reads a snapshot: nothing is locked
            return F.lit(False)
        if e.name == "accum":  # what an earlier ACCUMULATE has left
            return self.name(_accum_name(e.args[0].value, e.args[1]))
        if e.name == "available":
            b = e.args[0].name.lower()
            return F.col(self.buffers[b][self.env.catalog.order_of(b)[0].lower()]).isNotNull()
        if e.name in self.env.functions:
            f = self.env.functions[e.name]
            out = self.expr(_called(f, e.args))
            return out.cast(TYPES[f.type]) if f.type in TYPES else out
        if e.name in scalar.WORD_LAST and isinstance(e.args[-1], S.Literal):
            return scalar.call(e.name, [self.expr(a) for a in e.args[:-1]], e.args[-1].value)
        return scalar.call(e.name, [self.expr(a) for a in e.args])

    def binary(self, e: S.Binary) -> Column:
        if e.op in ("=", "<>") and isinstance(e.right, S.Unknown):
            return self.expr(e.left).isNull() if e.op == "=" else self.expr(e.left).isNotNull()
        if e.op == "like":
            return self.expr(e.left).like(e.right.value)
        a = self.expr(e.left)
        if e.op == "matches":
            if isinstance(e.right, S.Literal):
                return a.like(like_pattern(e.right.value))
            p = F.regexp_replace(self.expr(e.right), r"([\\\[\](){}+^$|?])", r"\\$1")
            return F.rlike(a, F.concat(F.lit("(?s)^"), F.replace(p, F.lit("*"), F.lit(".*")), F.lit("$")))
        b = self.expr(e.right)
        if e.op in _COMPARES:
            return _COMPARES[e.op](a, b)
        if e.op == "begins":
            return F.startswith(a, b)
        if e.op == "contains":
            return F.contains(a, b)
        if e.op == "and":
            return a & b
        if e.op == "or":
            return a | b
        if e.op == "+":
            return F.concat(a, b) if self.is_text(e) else a + b
        return {"-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "mod": lambda: a % b}[e.op]()

    def is_text(self, e) -> bool:
        """Whether an expression is a text, as far as its leaves show."""
        if isinstance(e, S.Literal):
            return isinstance(e.value, str)
        if isinstance(e, S.Binary):
            return e.op == "+" and (self.is_text(e.left) or self.is_text(e.right))
        if isinstance(e, S.Choice):
            return self.is_text(e.yes) or self.is_text(e.no)
        if isinstance(e, S.Call):
            return e.name in ("trim", "left-trim", "right-trim", "caps", "lc", "substring", "replace", "entry", "fill", "string", "quoter", "chr", "upper", "lower")
        if isinstance(e, (S.Name, S.Field)):
            return self.type_of(e) == "string"
        return False

    def read(self, e) -> set[str]:
        """The buffers that a tree reads; variables, unknown names and calls on records count as "?"."""
        if isinstance(e, S.Field):
            q = e.qualifier.split(".")[-1].lower()
            return {q} if q in self.buffers else {"?"}
        if isinstance(e, S.Name):
            low = e.name.lower()
            if low in self.locals or low in self.env.vars or low in self.blocked:
                return {"?"}
            return next(({b} for b in reversed(list(self.buffers)) if low in self.buffers[b]), {"?"})
        if isinstance(e, S.CanFind):
            return {"?"}
        if isinstance(e, (list, tuple)):
            return set().union(*map(self.read, e)) if e else set()
        if hasattr(e, "__dataclass_fields__"):
            return set().union(set(), *(self.read(getattr(e, f)) for f in e.__dataclass_fields__))
        return set()

    def type_of(self, e) -> str | None:
        q = e.qualifier.split(".")[-1].lower() if isinstance(e, S.Field) else None
        for b in [q] if q else reversed(list(self.buffers)):
            if b in self.buffers and e.name.lower() in self.buffers[b]:
                kinds = {c.lower(): t for c, t in self.env.catalog.table(b).dtypes}
                return kinds.get(e.name.lower())
        kind = self.env.types.get(e.name.lower())
        if kind:
            return TYPES.get(kind)
        v = self.env.vars.get(e.name.lower())
        return "string" if isinstance(v, Scalar) and isinstance(v.value, str) else None


def _conjuncts(where) -> list:
    if where is None:
        return []
    return _conjuncts(where.left) + _conjuncts(where.right) if isinstance(where, S.Binary) and where.op == "and" else [where]


def _names(e) -> set[str]:
    """Variable or field names read by a tree, lower case, unqualified."""
    if isinstance(e, S.Name):
        return {e.name.lower()}
    if isinstance(e, (list, tuple)):
        return set().union(*map(_names, e)) if e else set()
    if hasattr(e, "__dataclass_fields__") and not isinstance(e, S.Field):
        return set().union(set(), *(_names(getattr(e, f)) for f in e.__dataclass_fields__))
    return set()


@dataclass
class Update:
    """An assignment to a variable in a loop body: under guard (None: always), after how many LEAVEs.

    kind: sum, max, min or last; column and condition: what it adds, compares or stores, and when, as of its place.
    """

    guard: object
    target: str
    value: object
    stage: int
    kind: str = ""
    column: Column | None = None
    condition: Column | None = None


class Loop:
    """Rows of a record loop while its body is executed symbolically."""

    def __init__(self, env: Env):
        self.env, self.scope = env, Scope(env)
        self.rows: DataFrame | None = None
        self.keys: list[str] = []  # columns of the total order of the rows
        self.sort: list[tuple[Column, bool]] = []
        self.updates: list[Update] = []
        self.shown: list | None = None
        self.accumulated: list[S.Accumulate] = []
        self.assigned = False
        self.leaves: list[tuple[Column, int, list[str]]] = []
        self.levels: list[int] = []
        self.columns: list[str] = []
        self.breaks: list = []
        self.how: dict[str, str] = {}
        self.created: list[tuple[str, Column | None, dict[str, Column]]] = []
        self.deleted: list[tuple[str, Column | None]] = []
        self.exported: str | None = None
        self.skip = 0

    # -- rows
    def prefixed(self, buffer: str) -> tuple[DataFrame, dict[str, str]]:
        t = self.env.catalog.table(buffer)
        names = {c.lower(): f"{buffer.lower()}.{c}".replace(".", "__") for c in t.columns}
        return t.select(*[F.col(f"`{c}`").alias(names[c.lower()]) for c in t.columns]), names

    def enter(self, s: S.ForEach) -> None:
        """Join a buffer's rows: the scan, or a join with the rows so far on OF keys and WHERE."""
        right, names = self.prefixed(s.buffer)
        b = s.buffer.lower()
        if b in self.scope.buffers:
            raise LoweringError(f"buffer {s.buffer} is already in use; define a second one")
        self.scope.buffers[b] = names
        cond = self.of(s, b)
        plain, exists = self.split(s.where)
        if self.rows is not None and s.which != "each" and not exists:  # a lookup for each row so far
            find = S.Find(s.buffer, s.which, of=s.of, where=s.where)
            self.rows = self.with_lazies(self.rows)
            keys = self.lookup_keys(find, b)
            if keys:
                own = [names[c.lower()] for c in self.env.catalog.order_of(b)]
                self.reduced(find, b, right, own, *keys)
                self.keys = self.keys + own
                self.levels.append(len(self.keys))
                self.columns += list(names.values())
                self.sort += [(self.scope.expr(e), down) for e, down in s.by]
                return
        for e in plain:
            c = self.scope.expr(e)
            cond = c if cond is None else cond & c
        if self.rows is None:
            self.rows = self.with_lazies(right)
            self.rows = self.rows if cond is None else self.rows.where(cond)
        else:
            self.rows = self.with_lazies(self.rows)
            self.rows = self.rows.join(right, cond) if cond is not None else self.rows.crossJoin(right)
        for negated, find in exists:
            self.exists(find, negated)
        own = [names[c.lower()] for c in self.env.catalog.order_of(b)]
        if s.which != "each":
            direction = (lambda c: F.col(c).desc()) if s.which == "last" else F.col
            if self.keys:
                w = Window.partitionBy(*self.keys).orderBy(*map(direction, own))
                self.rows = self.rows.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")
            else:
                self.rows = self.rows.orderBy(*map(direction, own)).limit(1)
        self.keys = self.keys + own
        self.levels.append(len(self.keys))
        self.columns += list(names.values())
        self.sort += [(self.scope.expr(e), down) for e, down in s.by]
        self.skip += s.skip
        if s.breaks:
            self.breaks = [e for e, _ in s.by]
            self.break_by(s.by)

    def of(self, s, b: str) -> Column | None:
        if not s.of:
            return None
        if s.of.lower() not in self.scope.buffers:  # a parent that isn't looped over: its rows are joined and checked to exist
            parent = self.env.records.get(s.of.lower())
            if parent is None:
                raise LoweringError(f"OF {s.of}: no such record in scope")
            return self.of_record(s, b, parent)
        cond = None
        for mine, theirs in self.env.catalog.keys(s.buffer, s.of):
            c = self.scope.column(b, mine) == self.scope.column(s.of.lower(), theirs)
            cond = c if cond is None else cond & c
        return cond

    def of_record(self, s, b: str, parent: DataFrame) -> Column:
        cond = None
        for mine, theirs in self.env.catalog.keys(s.buffer, s.of):
            self.scope.lazies[f"of_{theirs}"] = Lazy(parent, theirs)
            c = self.scope.column(b, mine) == F.col(f"__var_of_{theirs}")
            cond = c if cond is None else cond & c
        return cond

    def with_lazies(self, df: DataFrame) -> DataFrame:
        """Join the one-row frames that an expression has named since the last call."""
        for low, v in list(self.scope.lazies.items()):
            if f"__var_{low}" not in df.columns:
                df = df.crossJoin(F.broadcast(v.frame.select(F.col(v.column).alias(f"__var_{low}")).limit(1)))
        return df

    def split(self, where) -> tuple[list, list]:
        """Conjuncts of a condition: plain ones, and CAN-FIND ones with whether they are negated."""
        if where is None:
            return [], []
        if isinstance(where, S.Binary) and where.op == "and":
            a, b = self.split(where.left), self.split(where.right)
            return a[0] + b[0], a[1] + b[1]
        if isinstance(where, S.CanFind):
            return [], [(False, where.find)]
        if isinstance(where, S.Unary) and where.op == "not" and isinstance(where.value, S.CanFind):
            return [], [(True, where.value.find)]
        return [where], []

    def exists(self, find: S.Find, negated: bool) -> None:
        """CAN-FIND as a semi join, NOT CAN-FIND as an anti join."""
        right, cond = self.matching(find)
        if cond is None:
            raise LoweringError("CAN-FIND needs a condition")
        self.rows = self.rows.join(right, cond, "left_anti" if negated else "left_semi")
        del self.scope.buffers[find.buffer.lower()]

    def matching(self, find: S.Find) -> tuple[DataFrame, Column | None]:
        """A FIND's table, entered into the scope, and its condition on it and the rows so far."""
        right, names = self.prefixed(find.buffer)
        b = find.buffer.lower()
        if b in self.scope.buffers:
            raise LoweringError(f"buffer {find.buffer} is already in use; define a second one")
        self.scope.buffers[b] = names
        cond = self.of(find, b)
        if find.key is not None:
            key = self.env.catalog.order_of(b)
            c = self.scope.column(b, key[0]) == self.scope.expr(find.key)
            cond = c if cond is None else cond & c
        if find.where is not None:
            c = self.scope.expr(find.where)
            cond = c if cond is None else cond & c
        return right, cond

    def find(self, s: S.Find) -> None:
        """A lookup for each row: the first or last match in the table's order, or the only one; NO-ERROR keeps unmatched rows.

        If the condition compares fields of the table for equality, the table is first reduced to one row a key, so that
        nothing multiplies; else all matches are joined and the wanted one is picked among them.
        """
        if s.which in ("next", "prev"):
            return self.neighbour(s)
        right, cond = self.matching(s)
        if cond is None:
            raise LoweringError("FIND in a loop needs a condition")
        b = s.buffer.lower()
        names = self.scope.buffers[b]
        own = [names[c.lower()] for c in self.env.catalog.order_of(b)]
        self.rows = self.with_lazies(self.rows)
        keys = self.lookup_keys(s, b)
        if keys:
            self.reduced(s, b, right, own, *keys)
        else:
            joined = self.rows.join(right, cond, "left" if s.no_error else "inner")
            order = [F.col(c).desc() if s.which == "last" else F.col(c) for c in own]
            w = Window.partitionBy(*self.keys)
            if s.which == "unique":
                joined = joined.withColumn(f"__many_{b}", F.count(F.lit(1)).over(w) > 1)
                joined = joined.withColumn("__nth", F.row_number().over(w.orderBy(*order))).where("__nth = 1").drop("__nth")
                self.rows = self.one_only(s, b, joined)
            else:
                self.rows = joined.withColumn("__nth", F.row_number().over(w.orderBy(*order))).where("__nth = 1").drop("__nth")
        self.columns += list(names.values())

    def one_only(self, s: S.Find, b: str, joined: DataFrame) -> DataFrame:
        """A FIND of the only match: several raise, or with NO-ERROR leave the record unavailable and AMBIGUOUS."""
        many = F.col(f"__many_{b}")
        if not s.no_error:
            return joined.where(F.assert_true(~many, F.lit(f"more than one {s.buffer}")).isNull())
        self.scope.special["ambiguous", b] = F.coalesce(many, F.lit(False))
        return joined.withColumns({c: F.when(~F.coalesce(many, F.lit(False)), F.col(c)) for c in self.scope.buffers[b].values()})

    def lookup_keys(self, s: S.Find, b: str):
        """(pairs of equal columns of the table and of the rows, conditions on the table alone) of a FIND's conditions; None if others are among them."""
        table, pairs, alone = {b}, [], []
        if s.of:
            if s.of.lower() not in self.scope.buffers:
                return None
            pairs += [(self.scope.column(b, mine), self.scope.column(s.of.lower(), theirs)) for mine, theirs in self.env.catalog.keys(s.buffer, s.of)]
        if s.key is not None:
            pairs.append((self.scope.column(b, self.env.catalog.order_of(b)[0]), self.scope.expr(s.key)))
        for e in _conjuncts(s.where):
            read = self.scope.read(e)
            if read == table:
                alone.append(self.scope.expr(e))
            elif isinstance(e, S.Binary) and e.op == "=" and not isinstance(e.right, S.Unknown):
                sides = [self.scope.read(x) for x in (e.left, e.right)]
                if sides[0] == table and b not in sides[1]:
                    pairs.append((self.scope.expr(e.left), self.scope.expr(e.right)))
                elif sides[1] == table and b not in sides[0]:
                    pairs.append((self.scope.expr(e.right), self.scope.expr(e.left)))
                else:
                    return None
            else:
                return None
        return (pairs, alone) if pairs else None

    def reduced(self, s: S.Find, b: str, right: DataFrame, own: list[str], pairs: list, alone: list) -> None:
        names = list(self.scope.buffers[b].values())
        for c in alone:
            right = right.where(c)
        pick = F.max_by if s.which == "last" else F.min_by
        best = right.groupBy(*[mine.alias(f"__k{i}_{b}") for i, (mine, _) in enumerate(pairs)]).agg(pick(F.struct(*names), F.struct(*own)).alias(f"__r_{b}"), (F.count(F.lit(1)) > 1).alias(f"__many_{b}"))
        cond = None
        for i, (_, theirs) in enumerate(pairs):
            c = F.col(f"__k{i}_{b}") == theirs
            cond = c if cond is None else cond & c
        joined = self.rows.join(best, cond, "left" if s.no_error else "inner")
        joined = joined.withColumns({c: F.col(f"__r_{b}")[c] for c in names}).drop(f"__r_{b}", *[f"__k{i}_{b}" for i in range(len(pairs))])
        self.rows = self.one_only(s, b, joined) if s.which == "unique" else joined

    def neighbour(self, s: S.Find) -> None:
        """FIND NEXT or PREV of a second buffer of the looped table: the row beside along the table's order, found by ranges."""
        base = self.env.catalog.buffers.get(s.buffer.lower())
        if base not in self.scope.buffers or s.where is not None:
            raise LoweringError("FIND NEXT or PREV in a loop needs a second buffer of the looped table and no condition")
        b, names = s.buffer.lower(), {}
        own = [self.scope.buffers[base][c.lower()] for c in self.env.catalog.order_of(base)]
        whole = F.struct(*[F.col(c).alias(k) for k, c in self.scope.buffers[base].items()])
        self.rows = records.beside(self.with_lazies(self.rows), own, whole, s.which == "next", "__move")
        for k in self.scope.buffers[base]:
            names[k] = f"{b}__{k}"
            self.rows = self.rows.withColumn(names[k], F.col("__move")[k])
        self.rows = self.rows.drop("__move")
        if not s.no_error:
            self.rows = self.rows.where(F.col(names[self.env.catalog.order_of(base)[0].lower()]).isNotNull())
        self.scope.buffers[b] = names
        self.columns += list(names.values())

    def break_by(self, by: list) -> None:
        """FIRST-OF and LAST-OF of each break field: whether a row is the outermost of its group."""
        cols = [self.scope.expr(e) for e, _ in by]
        self.rows = self.with_lazies(self.rows)
        for i, (e, _) in enumerate(by):
            order = records.order_key(self.rows, [*zip(cols[i + 1 :], [d for _, d in by[i + 1 :]]), *((F.col(k), False) for k in self.keys)])
            self.rows = records.marked(self.rows, cols[: i + 1], order, f"__first_of_{i}", f"__last_of_{i}")
            self.scope.special["first-of", e] = F.col(f"__first_of_{i}")
            self.scope.special["last-of", e] = F.col(f"__last_of_{i}")

    # -- body
    def body(self, statements: list, guard=None) -> object:
        """Execute statements under a guard tree; returns the guard for what follows (NEXT narrows it)."""
        for s in statements:
            guard = self.step(s, guard)
        return guard

    def step(self, s, guard):  # noqa: C901
        if isinstance(s, (S.Empty, S.Declare)):
            if isinstance(s, S.Declare):
                declare(self.env, s)
        elif isinstance(s, S.ForEach):
            if guard is not None:
                self.rows = self.rows.where(self.condition(guard))
            self.enter(s)
            self.body(s.body)
        elif isinstance(s, S.Find):
            self.find(s)
        elif isinstance(s, S.Assign):
            self.assign(s, guard)
        elif isinstance(s, S.If):
            if _only(s.yes, S.Next) and not s.no:
                return _both(guard, ("unless", s.cond))
            if _only(s.yes, (S.Leave, S.Return)) and not s.no:
                self.leave(s.cond, guard)
                return guard
            if s.cond == S.Literal(True) and not s.no:
                return self.body(s.yes, guard)
            self.body(_flat(s.yes), _both(guard, ("if", s.cond)))
            self.body(_flat(s.no), _both(guard, ("unless", s.cond)))
        elif isinstance(s, S.Case):
            taken: list = []
            for values, then in s.branches:
                cond = None
                for v in values:
                    one = S.Binary("=", s.value, v)
                    cond = one if cond is None else S.Binary("or", cond, one)
                g = guard
                for t in taken:
                    g = _both(g, ("unless", t))
                self.body(_flat(then), _both(g, ("if", cond)))
                taken.append(cond)
            rest = guard
            for t in taken:
                rest = _both(rest, ("unless", t))
            self.body(_flat(s.otherwise), rest)
        elif isinstance(s, S.Do) and s.var is None and s.cond is None:
            return self.body(s.body, guard)
        elif isinstance(s, S.Display):
            if guard is not None:
                self.rows = self.with_lazies(self.rows).where(self.condition(guard))
            self.shown = self.listed(s)
        elif isinstance(s, S.Export):
            if "output" not in self.env.paths:
                raise LoweringError("EXPORT needs OUTPUT TO")
            if guard is not None:
                self.rows = self.with_lazies(self.rows).where(self.condition(guard))
            self.shown, self.exported = self.listed(S.Display(s.items)), s.delimiter
        elif isinstance(s, S.Create):
            self.created.append((s.buffer.lower(), self.condition(guard), {}))
        elif isinstance(s, S.Delete):
            if s.buffer.lower() not in self.scope.buffers:
                raise LoweringError(f"DELETE of {s.buffer}, which isn't looped over")
            self.deleted.append((s.buffer.lower(), self.condition(guard)))
        elif isinstance(s, S.Release):
            pass
        elif isinstance(s, S.Accumulate):
            self.accumulated.append(s)
        elif isinstance(s, (S.Leave, S.Return)):
            self.leave(S.Literal(True), guard)
        elif isinstance(s, S.Next):
            return _both(guard, ("if", S.Literal(False)))
        elif isinstance(s, S.Evaluate):
            self.scope.expr(s.value)
        elif isinstance(s, S.Run):
            proc = self.env.procedures.get(_text_of(self.env, s.target).lower())
            if proc is None:
                raise LoweringError("RUN of an unknown procedure")
            return self.body(_inlined(proc, s.args), guard)
        else:
            raise LoweringError(f"{type(s).__name__} in a record loop has no plan")
        return guard

    def listed(self, s: S.Display) -> list:
        """Items of a DISPLAY with a record's name replaced by its fields."""
        gone, out = {e.name.lower() for e in s.besides}, []
        for e, label, form in s.items:
            if isinstance(e, S.Name) and e.name.lower() in self.scope.buffers and not self.owner(e.name):
                out += [(S.Field(e.name, c), None, None) for c in self.env.catalog.table(e.name).columns if c.lower() not in gone]
            elif not (isinstance(e, (S.Name, S.Field)) and e.name.lower() in gone):
                out.append((e, label, form))
        return out

    def condition(self, guard) -> Column | None:
        """A guard tree as a condition that is never null."""
        if guard is None:
            return None
        out = None
        for kind, cond in guard:
            c = F.coalesce(self.scope.expr(cond), F.lit(False))
            c = ~c if kind == "unless" else c
            out = c if out is None else out & c
        return out

    def assign(self, s: S.Assign, guard) -> None:
        made = isinstance(s.target, S.Field) and next((c for c in reversed(self.created) if c[0] == s.target.qualifier.split(".")[-1].lower()), None)
        if made:  # a field of the record that this iteration creates
            new, g = self.scope.expr(self.with_running(s.value, guard)), self.condition(guard)
            low = s.target.name.lower()
            made[2][low] = new if g is None else F.when(g, new).otherwise(made[2].get(low, F.lit(None)))
            return
        if isinstance(s.target, S.Field) or (isinstance(s.target, S.Name) and s.target.name.lower() not in self.env.vars and self.owner(s.target.name)):
            b = s.target.qualifier.split(".")[-1].lower() if isinstance(s.target, S.Field) else self.owner(s.target.name)
            if b not in self.scope.buffers:
                raise LoweringError(f"unknown buffer {b}")
            old = self.scope.column(b, s.target.name)
            new = self.scope.expr(self.with_running(s.value, guard))
            g = self.condition(guard)
            self.rows = self.with_lazies(self.rows)
            self.scope.fields[b, s.target.name.lower()] = new if g is None else F.when(g, new).otherwise(old)
            self.assigned = True
            return
        if not isinstance(s.target, S.Name):
            raise LoweringError("element assignment in a record loop has no plan")
        low = s.target.name.lower()
        if low not in self.env.vars:
            raise LoweringError(f"unknown variable {s.target.name}")
        u = Update(guard, low, s.value, len(self.leaves))
        self.updates.append(u)
        if low in self.scope.locals:  # a later assignment of the same iteration
            g, new = self.condition(guard), self.scope.expr(s.value)
            u.kind, u.column = "last", new if g is None else F.when(g, new).otherwise(self.scope.locals[low])
            self.scope.locals[low] = u.column
            return
        added, extreme = _added(u), _extreme(u)
        if added is not None:
            u.kind, u.column, u.condition = "sum", self.scope.expr(added), self.condition(guard)
        elif extreme is not None:
            u.kind, u.column, u.condition = extreme[0], self.scope.expr(extreme[1]), self.condition(extreme[2])
        else:
            u.kind, u.column, u.condition = "last", self.scope.expr(s.value), self.condition(guard)
            if guard is None:
                self.scope.locals[low] = u.column
                self.scope.blocked.discard(low)

    def block(self, statements: list) -> None:
        """Variables that a body assigns carry values between iterations until the body has set them."""
        for s in statements:
            if isinstance(s, S.Assign) and isinstance(s.target, S.Name) and s.target.name.lower() in self.env.vars:
                self.scope.blocked.add(s.target.name.lower())
            elif isinstance(s, S.Run) and isinstance(s.target, S.Literal) and str(s.target.value).lower() in self.env.procedures:
                self.block(self.env.procedures[str(s.target.value).lower()].body)
            elif isinstance(s, S.Case):
                for _, then in s.branches:
                    self.block(then)
                self.block(s.otherwise)
            else:
                for part in ("body", "yes", "no"):
                    self.block(getattr(s, part, []) or [])

    def owner(self, name: str) -> str | None:
        return next((b for b in reversed(list(self.scope.buffers)) if name.lower() in self.scope.buffers[b]), None)

    def with_running(self, e, guard):
        """Reading a sum in the iteration that adds to it: a running window over the rows' order."""
        for low in _names(e) & self.scope.blocked:
            own = [u for u in self.updates if u.target == low]
            if not own or any(u.kind != "sum" for u in own):
                raise LoweringError(f"{low} is read inside the loop but isn't a running sum so far")
            each = None
            for u in own:
                x = u.column if u.condition is None else F.when(u.condition, u.column)
                each = F.coalesce(x, F.lit(0)) if each is None else each + F.coalesce(x, F.lit(0))
            order = self.sort + [(F.col(k), False) for k in self.keys]
            start = self.start(low)
            self.rows = records.running_sum(self.with_lazies(self.rows), each, order, f"__sum_{low}").withColumn(f"__run_{low}", start + F.col(f"__sum_{low}")).drop(f"__sum_{low}")
            self.scope.locals[low] = F.col(f"__run_{low}")
            self.scope.blocked.discard(low)
        return e

    def start(self, low: str) -> Column:
        v = self.env.vars[low]
        if isinstance(v, Lazy):
            self.scope.lazies[low] = v
            return F.col(f"__var_{low}")
        return _literal(v)

    def leave(self, cond, guard) -> None:
        c = F.coalesce(self.scope.expr(cond), F.lit(False))
        g = self.condition(guard)
        self.leaves.append((c if g is None else c & g, len(self.leaves), list(self.keys)))

    def order(self, keys: list[str]) -> Column:
        """The loop's order as one value to compare by, whatever the types of its BY keys."""
        return records.order_key(self.rows, [*self.sort, *((F.col(k), False) for k in keys)])

    def cut(self) -> None:
        """Rows up to the first that leaves, in the loop's order: rows before a LEAVE in the body also run for that row.

        In an outer loop the cut is one aggregate over the rows, joined as one row; in an inner loop a window over the
        outer rows' keys. Adds __live_k: whether the row runs what follows the k-th LEAVE.
        """
        for k, (cond, _, keys) in enumerate(self.leaves):
            order = self.order(keys)
            outer = keys[: self.levels[-2]] if len(self.levels) > 1 else []
            first = F.min(F.when(cond, order))
            if outer:
                self.rows = self.rows.withColumn("__cut", first.over(Window.partitionBy(*outer)))
            else:
                self.rows = self.rows.crossJoin(F.broadcast(self.rows.agg(first.alias("__cut"))))
            self.rows = self.rows.withColumn(f"__live_{k + 1}", F.col("__cut").isNull() | (order < F.col("__cut"))).withColumn(f"__live_{k}", F.col("__cut").isNull() | (order <= F.col("__cut"))).drop("__cut")

    # -- results
    def finish(self) -> None:
        env = self.env
        self.rows = self.with_lazies(self.rows)
        names = sorted({u.target for u in self.updates})
        plans = {n: self.aggregate(n) for n in names}
        self.rows = self.with_lazies(self.rows)
        self.cut()
        if self.leaves and not names:
            self.rows = self.rows.where(f"__live_{len(self.leaves)}")
        self.change()
        if names:
            flat = self.rows
            aggs = [plans[n]().alias(n) for n in names]
            frame = flat.agg(*aggs)
            starts = [n for n in names if isinstance(env.vars[n], Lazy)]
            for n in starts:
                frame = frame.crossJoin(env.vars[n].frame.select(F.col(env.vars[n].column).alias(f"__start_{n}")))
            frame = frame.select(*[self.closed(n, F.col(f"__start_{n}") if n in starts else _literal(env.vars[n])).alias(n) for n in names])
            for n in names:
                env.vars[n] = Lazy(frame, n)
        if self.accumulated:
            env.rows.append(self.accumulates())
            if not self.breaks:
                for a in self.accumulated:
                    env.vars |= {_accum_name(k, a.value): Lazy(env.rows[-1], f"{_label(a.value, 0)}_{k.replace('-', '_')}") for k in a.kinds}
        if self.shown is not None:
            out = self.with_lazies(self.rows)
            if self.sort or self.skip:
                out = out.orderBy(*[c.desc() if d else c.asc() for c, d in self.sort], *self.keys)
            out = out.offset(self.skip) if self.skip else out
            out = out.select(*[self.scope.expr(e).alias(label or _label(e, i)) for i, (e, label, _) in enumerate(self.shown)])
            forms = {out.columns[i]: form for i, (_, _, form) in enumerate(self.shown) if form}
            out = out.select(*[scalar.formatted(F.col(f"`{c}`"), forms[c], t).alias(c) if c in forms else F.col(f"`{c}`") for c, t in out.dtypes])
            if self.exported is not None:
                files.export(out, env.paths["output"], self.exported)
            else:
                env.rows.append(out)
        elif not names and not self.accumulated and not self.created and not self.deleted:
            env.rows.append(self.result())

    def change(self) -> None:
        """Records created, deleted or, in temp-tables, assigned by the loop: the tables become new plans, set-wise."""
        catalog, rows = self.env.catalog, self.with_lazies(self.rows)
        live = F.col(f"__live_{len(self.leaves)}") if self.leaves else F.lit(True)
        for b, guard, fields in self.created:
            old = catalog.table(b)
            picked = rows.where(live if guard is None else live & guard)
            new = picked.select(*[fields.get(c.lower(), F.lit(None)).cast(t).alias(c) for c, t in old.dtypes])
            catalog.replace(b, old.unionByName(new))
        for b, guard in self.deleted:
            catalog.replace(b, self.without(b, rows.where(live if guard is None else live & guard)))
        if self.assigned and len(self.scope.buffers) == 1 and not self.created:
            b = next(iter(self.scope.buffers))
            if catalog.key(b) in catalog.temps:
                cols = [self.scope.fields.get((b, c.lower()), F.col(self.scope.buffers[b][c.lower()])).cast(t).alias(c) for c, t in catalog.table(b).dtypes]
                catalog.replace(b, self.without(b, rows.where(live)).unionByName(rows.where(live).select(*cols)))

    def without(self, b: str, rows: DataFrame) -> DataFrame:
        """A buffer's table without the records of some rows, told by its order's columns."""
        table, own = self.env.catalog.table(b), self.env.catalog.order_of(b)
        gone = rows.select(*[F.col(self.scope.buffers[b][c.lower()]).alias(f"__gone_{c}") for c in own]).distinct()
        cond = F.lit(True)
        for c in own:
            cond = cond & F.col(c).eqNullSafe(F.col(f"__gone_{c}"))
        return table.join(gone, cond, "left_anti")

    def result(self) -> DataFrame:
        """All buffers' columns in buffer order; a name that two buffers share is prefixed by its buffer."""
        seen: dict[str, int] = {}
        for c in self.columns:
            plain = c.split("__", 1)[1]
            seen[plain] = seen.get(plain, 0) + 1
        out = self.rows
        if self.sort or self.skip:
            out = out.orderBy(*[c.desc() if d else c.asc() for c, d in self.sort], *self.keys)
        out = out.offset(self.skip) if self.skip else out
        cols = []
        for c in self.columns:
            b, plain = c.split("__", 1)
            value = self.scope.fields.get((b, plain.lower()), F.col(c))
            cols.append(value.alias(plain if seen[plain] == 1 else f"{b}_{plain}"))
        return out.select(*cols)

    def accumulates(self) -> DataFrame:
        """One row, or with BREAK BY one row a group and the sub-totals above (a rollup)."""
        makers = {"total": F.sum, "sub-total": F.sum, "count": F.count, "average": F.avg, "minimum": F.min, "maximum": F.max, "sub-count": F.count, "sub-average": F.avg, "sub-minimum": F.min, "sub-maximum": F.max}
        aggs = []
        for a in self.accumulated:
            for k in a.kinds:
                if k not in makers:
                    raise LoweringError(f"ACCUMULATE {k}")
                aggs.append(makers[k](self.scope.expr(a.value)).alias(f"{_label(a.value, 0)}_{k.replace('-', '_')}"))
        if self.breaks:
            return self.rows.rollup(*[self.scope.expr(e).alias(_label(e, i)) for i, e in enumerate(self.breaks)]).agg(*aggs)
        return self.rows.agg(*aggs)

    def live(self, u: Update) -> Column | None:
        return F.col(f"__live_{u.stage}") if self.leaves else None

    def guarded(self, u: Update) -> Column | None:
        live = self.live(u)
        return u.condition if live is None else live if u.condition is None else u.condition & live

    def aggregate(self, name: str):
        """The aggregate that a variable's updates amount to, built once the rows are cut."""
        own = [u for u in self.updates if u.target == name]
        kinds = {u.kind for u in own}
        if len(kinds) > 1:
            raise LoweringError(f"updates of {name} mix {', '.join(sorted(kinds))}")
        kind = kinds.pop()
        self.how[name] = kind

        def total() -> Column:
            out = None
            for u in own:
                g = self.guarded(u)
                x = F.coalesce(F.sum(u.column if g is None else F.when(g, u.column)), F.lit(0))
                out = x if out is None else out + x
            return out

        def best() -> Column:
            fold, pair = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            outs = [fold(u.column if (g := self.guarded(u)) is None else F.when(g, u.column)) for u in own]
            return outs[0] if len(outs) == 1 else pair(*outs)

        def last() -> Column:
            value = hit = None
            for u in own:
                g = self.guarded(u)
                value = u.column if g is None else F.when(g, u.column) if value is None else F.when(g, u.column).otherwise(value)
                hit = F.lit(True) if g is None else g if hit is None else hit | g
            order = self.order(self.keys)
            return F.max_by(F.struct(value.alias("v")), F.when(hit, order))

        return {"sum": total, "last": last}.get(kind, best)

    def closed(self, name: str, start: Column) -> Column:
        """An aggregate joined with the variable's value before the loop."""
        kind, got = self.how[name], F.col(name)
        if kind == "sum":
            return start + got
        if kind == "last":
            return F.when(got.isNull(), start).otherwise(got["v"])
        return (F.greatest if kind == "max" else F.least)(start, got)


def _flat(statements: list) -> list:
    """The statements of a plain DO block in place of it."""
    return [x for s in statements for x in (_flat(s.body) if isinstance(s, S.Do) and s.var is None and s.cond is None else [s])]


def _only(statements: list, kind) -> bool:
    return len(_flat(statements)) == 1 and isinstance(_flat(statements)[0], kind)


def _both(guard, more):
    return (*(guard or ()), more)


def _label(e, i: int) -> str:
    return e.name if isinstance(e, (S.Name, S.Field)) else f"expr_{i + 1}"


def _accum_name(kind: str, e) -> str:
    return f"accum_{kind}_{_label(e, 0)}".lower()


def _added(u: Update):
    """e of x = x + e, x = e + x or x = x - e, if e and the guard don't read x; else None."""
    v = u.value
    if not isinstance(v, S.Binary) or v.op not in ("+", "-") or u.target in _names([c for _, c in u.guard or ()]):
        return None
    is_x = lambda e: isinstance(e, S.Name) and e.name.lower() == u.target
    if is_x(v.left) and u.target not in _names(v.right):
        return v.right if v.op == "+" else S.Unary("-", v.right)
    if v.op == "+" and is_x(v.right) and u.target not in _names(v.left):
        return v.left
    if isinstance(v.left, S.Binary) and u.target in _names(v.left) and u.target not in _names(v.right):
        inner = _added(Update(u.guard, u.target, v.left, u.stage))
        return None if inner is None else S.Binary(v.op, inner, v.right)
    return None


def _extreme(u: Update):
    """("max" or "min", e, rest of the guard) of IF e > x THEN x = e and of x = MAXIMUM(x, e); else None."""
    v = u.value
    if isinstance(v, S.Call) and v.name in ("maximum", "minimum", "max", "min") and len(v.args) == 2:
        mine = [a for a in v.args if isinstance(a, S.Name) and a.name.lower() == u.target]
        rest = [a for a in v.args if a not in mine]
        if len(mine) == 1 and u.target not in _names(rest[0]):
            return ("max" if v.name.startswith("max") else "min", rest[0], u.guard)
        return None
    if not u.guard or u.target in _names(v):
        return None
    kind, cond = u.guard[-1]
    if kind != "if" or not isinstance(cond, S.Binary) or cond.op not in ("<", "<=", ">", ">="):
        return None
    left, right, op = cond.left, cond.right, cond.op
    if isinstance(left, S.Name) and left.name.lower() == u.target:
        left, right, op = right, left, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op]
    if left != v or not (isinstance(right, S.Name) and right.name.lower() == u.target) or u.target in _names([c for _, c in u.guard[:-1]]):
        return None
    return ("max" if op[0] == ">" else "min", v, u.guard[:-1] or None)


def _inlined(proc: S.Procedure, args: list) -> list:
    """A procedure's body for use in a loop: input parameters replaced by the arguments' trees."""
    params = [p for p in proc.body if isinstance(p, S.Parameter)]
    if len(params) != len(args):
        raise LoweringError(f"{proc.name} takes {len(params)} arguments")
    by = {p.name.lower(): a for p, (_, a) in zip(params, args)}
    return [_replaced(s, by) for s in proc.body if not isinstance(s, S.Parameter)]


def _called(f: S.Function, args: tuple):
    """A function's result as one expression of its arguments: its statements are followed, an IF becomes a choice."""
    if len(args) != len(f.params):
        raise LoweringError(f"{f.name} takes {len(f.params)} arguments")
    return _returned(f.body, {p.name.lower(): a for p, a in zip(f.params, args)})


def _returned(statements: list, by: dict):
    for i, s in enumerate(statements):
        rest = statements[i + 1 :]
        if isinstance(s, S.Return):
            return S.Unknown() if s.value is None else _replaced(s.value, by)
        if isinstance(s, S.Declare):
            by = by | {s.name.lower(): S.Literal(_DEFAULTS.get(s.type)) if s.initial is None else _replaced(s.initial, by)}
        elif isinstance(s, S.Assign) and isinstance(s.target, S.Name):
            by = by | {s.target.name.lower(): _replaced(s.value, by)}
        elif isinstance(s, S.If):
            return S.Choice(_replaced(s.cond, by), _returned([*s.yes, *rest], by), _returned([*s.no, *rest], by))
        elif isinstance(s, S.Case):
            out = _returned([*s.otherwise, *rest], by)
            for values, then in reversed(s.branches):
                cond = None
                for v in values:
                    one = S.Binary("=", s.value, v)
                    cond = one if cond is None else S.Binary("or", cond, one)
                out = S.Choice(_replaced(cond, by), _returned([*then, *rest], by), out)
            return out
        elif isinstance(s, S.Do) and s.var is None and s.cond is None:
            return _returned([*s.body, *rest], by)
        elif not isinstance(s, (S.Empty, S.Parameter)):
            raise LoweringError(f"{type(s).__name__} in a function has no plan")
    return S.Unknown()


def _replaced(e, by: dict):
    if isinstance(e, S.Name):
        return by.get(e.name.lower(), e)
    if isinstance(e, (list, tuple)):
        return type(e)(_replaced(x, by) for x in e)
    if hasattr(e, "__dataclass_fields__") and not isinstance(e, S.Field):
        return type(e)(**{f: _replaced(getattr(e, f), by) for f in e.__dataclass_fields__})
    return e


# -- driver-side scalars


def constant(env: Env, e):
    """The value of an expression over driver-side scalars; raises LoweringError if it needs a table."""
    if isinstance(e, S.Literal):
        return e.value
    if isinstance(e, S.Unknown):
        return None
    if isinstance(e, S.Name) and isinstance(env.vars.get(e.name.lower()), Scalar):
        return env.vars[e.name.lower()].value
    if isinstance(e, S.Choice):
        return constant(env, e.yes if constant(env, e.cond) else e.no)
    if isinstance(e, S.Index):
        return constant(env, e.value)[int(constant(env, e.index)) - 1]
    if isinstance(e, S.Unary):
        v = constant(env, e.value)
        return None if v is None else (not v if e.op == "not" else -v)
    if isinstance(e, S.Binary):
        return _constant_binary(env, e)
    if isinstance(e, S.Call) and e.name in env.functions:
        return constant(env, _called(env.functions[e.name], e.args))
    raise LoweringError(f"{type(e).__name__} isn't a constant")


def _constant_binary(env: Env, e: S.Binary):
    if e.op in ("=", "<>") and isinstance(e.right, S.Unknown):
        return (constant(env, e.left) is None) == (e.op == "=")
    a, b = constant(env, e.left), constant(env, e.right)
    if e.op == "and":
        return False if a is False or b is False else None if a is None or b is None else True
    if e.op == "or":
        return True if a is True or b is True else None if a is None or b is None else False
    if a is None or b is None:
        return None
    if isinstance(a, float) != isinstance(b, float) and isinstance(a, (Decimal, float)) and isinstance(b, (Decimal, float)):
        a, b = float(a), float(b)
    if e.op in _COMPARES:
        return _COMPARES[e.op](a, b)
    if e.op == "mod":
        return a - b * int(a / b)
    if e.op == "/":
        return a / b if isinstance(a, Decimal) or isinstance(b, Decimal) or isinstance(a, float) or isinstance(b, float) else Decimal(a) / Decimal(b)
    simple = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "begins": lambda: a.startswith(b), "contains": lambda: b in a}
    if e.op not in simple:
        raise LoweringError(f"{e.op} isn't a constant")
    return simple[e.op]()


def _text_of(env: Env, e) -> str:
    return str(constant(env, e))


_DEFAULTS = {"integer": 0, "int64": 0, "decimal": Decimal(0), "character": "", "logical": False, "longchar": ""}


def declare(env: Env, s: S.Declare) -> None:
    if s.type not in TYPES:
        raise LoweringError(f"type {s.type} has no column form")
    low = s.name.lower()
    env.types[low] = s.type
    if s.extent is not None:
        values = [constant(env, x) for x in s.initial] if isinstance(s.initial, tuple) else [None if s.initial is None else constant(env, s.initial)] * s.extent
        env.vars[low] = Scalar(values + [_DEFAULTS.get(s.type)] * max(0, s.extent - len(values)), s.type)
        return
    value = _DEFAULTS.get(s.type)
    if s.initial is not None:
        try:
            value = constant(env, s.initial)
        except LoweringError:
            store(env, S.Assign(S.Name(s.name), s.initial), s.type)
            return
    env.vars[low] = Scalar(value, s.type)


def store(env: Env, s: S.Assign, kind: str | None = None) -> None:
    """A top-level assignment: a driver-side value where it can be one, else a one-row DataFrame."""
    if isinstance(s.target, S.Index) and isinstance(s.target.value, S.Name):
        v = env.vars[s.target.value.name.lower()]
        items = list(v.value)
        items[int(constant(env, s.target.index)) - 1] = constant(env, s.value)
        env.vars[s.target.value.name.lower()] = Scalar(items, v.type)
        return
    if isinstance(s.target, S.Field) and s.target.qualifier.lower() in env.pending:
        var = f"__new_{s.target.qualifier}_{s.target.name}".lower()
        store(env, S.Assign(S.Name(var), s.value))
        env.pending[s.target.qualifier.lower()][s.target.name.lower()] = var
        return
    if not isinstance(s.target, S.Name):
        raise LoweringError("field assignment outside a record loop has no plan")
    low = s.target.name.lower()
    kind = kind or env.types.get(low)
    try:
        env.vars[low] = Scalar(constant(env, s.value), kind)
        return
    except LoweringError:
        pass
    loop = Loop(env)
    for name, record in env.records.items():
        if any(isinstance(f, S.Field) and f.qualifier.lower() == name for f in _fields(s.value)):
            loop.scope.buffers[name] = {c.lower(): c for c in record.columns}
            loop.rows = record if loop.rows is None else loop.rows.crossJoin(record)
    value = loop.scope.expr(s.value)
    value = value.cast(TYPES[kind]) if kind in TYPES else value
    base = loop.rows if loop.rows is not None else env.catalog.spark.range(1)
    env.vars[low] = Lazy(loop.with_lazies(base).select(value.alias(low)), low)


def _fields(e) -> list:
    if isinstance(e, S.Field):
        return [e]
    if isinstance(e, (list, tuple)):
        return [x for i in e for x in _fields(i)]
    if hasattr(e, "__dataclass_fields__"):
        return [x for f in e.__dataclass_fields__ for x in _fields(getattr(e, f))]
    return []


class _Stop(Exception):
    pass


class _Skip(Exception):
    pass


class _Done(Exception):
    pass


class _Undone(Exception):
    pass


def flush(env: Env) -> None:
    """Records created outside of loops join their tables."""
    pending, env.pending = env.pending, {}
    for b, fields in pending.items():
        old = env.catalog.table(b)
        one = env.value(*fields.values())
        new = one.select(*[(F.col(fields[c.lower()]) if c.lower() in fields else F.lit(None)).cast(t).alias(c) for c, t in old.dtypes])
        env.catalog.replace(b, old.unionByName(new))


def define(env: Env, s: S.TempTable) -> None:
    """An empty table with an order: its primary index, else all its columns."""
    like = env.catalog.table(s.like).schema.fields if s.like else []
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in like), *(f"`{n}` {TYPES[t]}" for n, t in s.fields)])
    low = s.name.lower()
    env.catalog.tables[low] = env.catalog.spark.createDataFrame([], schema)
    env.catalog.temps.add(low)
    if s.order or s.like:
        env.catalog.order[low] = s.order or env.catalog.order_of(s.like)


_SQL_WORDS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "mod": "%", "modulo": "%", "?": "NULL"}
_AFTER_FROM = {"where", "group", "having", "order", "union", "except", "intersect", "limit", "offset", "window", "on", "using", ")", "select"}


def select(env: Env, s: S.Select) -> DataFrame:
    """A query over tables, buffers and temp-tables, planned by Spark SQL: joins, groups, sets, subqueries, windows.

    Names of driver-side variables stand for their values; tables are handed over as frames under their own names.
    """
    out, frames, inside, expects = [], {}, False, False
    for i, t in enumerate(s.tokens):
        word = t.text.lower()
        if t.kind in ("NoLock", "ShareLock", "ExclusiveLock"):
            continue
        if word in ("any", "some", "all") and i and (_SQL_WORDS.get(s.tokens[i - 1].text.lower(), s.tokens[i - 1].text)) in ("=", "<>", "<", "<=", ">", ">="):
            sign = out.pop().strip()
            if (sign, word == "all") not in (("=", False), ("<>", True)):
                raise LoweringError(f"{sign} {t.text} has no plan; compare with the least or the greatest")
            out.append(" NOT IN" if word == "all" else " IN")
            continue
        if t.kind == "StringLiteral":
            text = "'" + unescaped(t.value).replace("\\", "\\\\").replace("'", "\\'") + "'"
        elif expects and (word in env.catalog.buffers or word in env.catalog.tables):
            frames[f"t{len(frames)}"] = env.catalog.table(word)
            after = s.tokens[i + 1] if i + 1 < len(s.tokens) else None
            own = after is not None and (after.text.lower() == "as" or (after.kind == "Identifier" and after.text.lower() not in _AFTER_FROM | {"left", "right", "full", "inner", "cross", "join", "natural"}))
            out.append(f" \0t{len(frames) - 1}\1" + ("" if own else f" AS {t.text}"))
            expects = False
            continue
        elif isinstance(env.vars.get(word), Scalar) and (i == 0 or s.tokens[i - 1].text != "."):
            v = env.vars[word].value
            text = "NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
        else:
            text = _SQL_WORDS.get(word, t.text)
        inside = (inside or word == "from") and word not in _AFTER_FROM or word == "from"
        expects = word in ("from", "join") or (inside and word == ",")
        near = out and i and s.tokens[i - 1].end == t.start
        out.append(text if near else " " + text)
    sql = "SELECT" + "".join(out).replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")
    return env.catalog.spark.sql(sql, **frames)


def transaction(env: Env, s: S.Transaction) -> None:
    """A body whose variables and tables an UNDO or a caught error takes back. Plans are lazy: only errors of planning are caught."""
    tables = env.catalog.tables
    before = dict(env.vars), dict(tables), list(env.rows), dict(env.pending), dict(env.records)

    def back() -> None:
        env.vars, env.rows, env.pending, env.records = dict(before[0]), list(before[2]), dict(before[3]), dict(before[4])
        tables.clear()
        tables.update(before[1])

    try:
        try:
            execute(env, s.body)
        except _Undone:
            back()
        except (LoweringError, scalar.UnknownFunction, LookupError):
            if not s.catches:
                raise
            back()
            execute(env, s.catches[0])
    finally:
        execute(env, s.finally_)


def execute(env: Env, statements: list) -> None:
    for s in statements:
        _execute(env, s)


def _execute(env: Env, s) -> None:  # noqa: C901
    if env.pending and isinstance(s, (S.ForEach, S.Find, S.Select, S.Create, S.Delete, S.Release, S.EmptyTable, S.Do, S.Repeat, S.Import)):
        flush(env)
    if isinstance(s, S.Declare):
        declare(env, s)
    elif isinstance(s, S.Assign):
        store(env, s)
    elif isinstance(s, S.TempTable):
        define(env, s)
    elif isinstance(s, S.BufferFor):
        env.catalog.define_buffer(s.name, s.table)
    elif isinstance(s, S.DataSet):
        for parent, child, pairs in s.relations:
            env.catalog.relations[env.catalog.key(child), env.catalog.key(parent)] = tuple((c, p) for p, c in pairs)
    elif isinstance(s, S.Create):
        env.pending[s.buffer.lower()] = {}
    elif isinstance(s, S.Delete):
        found = env.records.pop(s.buffer.lower(), None)
        if found is None:
            raise LoweringError(f"DELETE of {s.buffer} before a FIND")
        loop = Loop(env)
        rows, names = loop.prefixed(s.buffer)
        loop.scope.buffers[s.buffer.lower()] = names
        env.catalog.replace(s.buffer, loop.without(s.buffer.lower(), found.select(*[F.col(c).alias(names[c.lower()]) for c in found.columns])))
    elif isinstance(s, S.EmptyTable):
        env.catalog.replace(s.name, env.catalog.table(s.name).limit(0))
    elif isinstance(s, S.Function):
        env.functions[s.name.lower()] = s
    elif isinstance(s, S.Select):
        out = select(env, s)
        if s.into:
            for name, column in zip(s.into, out.columns):
                env.vars[name.lower()] = Lazy(out, column)
        else:
            env.rows.append(out)
    elif isinstance(s, S.Transaction):
        transaction(env, s)
    elif isinstance(s, S.Undo):
        raise _Undone
    elif isinstance(s, S.Stream):
        env.paths.pop(s.direction, None)
        if s.path is not None:
            env.paths[s.direction] = str(constant(env, s.path))
    elif isinstance(s, S.Import) or (isinstance(s, S.Repeat) and any(isinstance(x, S.Import) for x in s.body)):
        one = s if isinstance(s, S.Import) else next(x for x in s.body if isinstance(x, S.Import))
        if "input" not in env.paths:
            raise LoweringError("IMPORT needs INPUT FROM")
        old = env.catalog.table(one.buffer)
        schema = ", ".join(f"`{c}` {t}" for c, t in old.dtypes)
        env.catalog.replace(one.buffer, old.unionByName(files.csv(env.catalog.spark, env.paths["input"], schema, one.delimiter)))
    elif isinstance(s, S.Release):
        pass
    elif isinstance(s, S.ForEach):
        loop = Loop(env)
        loop.enter(s)
        loop.block(s.body)
        loop.body(s.body)
        loop.finish()
    elif isinstance(s, S.Find):
        env.records[s.buffer.lower()] = find(env, s)
    elif isinstance(s, S.Procedure):
        env.procedures[s.name.lower()] = s
    elif isinstance(s, S.Run):
        run_procedure(env, s)
    elif isinstance(s, S.If):
        execute(env, s.yes if constant(env, s.cond) else s.no)
    elif isinstance(s, S.Case):
        value = constant(env, s.value)
        execute(env, next((then for values, then in s.branches if any(constant(env, v) == value for v in values)), s.otherwise))
    elif isinstance(s, S.Do):
        repeat(env, s) if s.var is None else count(env, s)
    elif isinstance(s, S.Repeat):
        repeat(env, s)
    elif isinstance(s, S.Leave):
        raise _Stop
    elif isinstance(s, S.Next):
        raise _Skip
    elif isinstance(s, S.Return):
        if s.value is not None:
            store(env, S.Assign(S.Name("__returned"), s.value))
            env.returned = env.vars["__returned"]
        raise _Done
    elif isinstance(s, S.Display):
        for i, (e, _, _) in enumerate(s.items):
            store(env, S.Assign(S.Name(f"__shown_{i}"), e))
        names = [f"__shown_{i}" for i in range(len(s.items))]
        env.rows.append(env.value(*names).toDF(*[label or _label(e, i) for i, (e, label, _) in enumerate(s.items)]))
    elif isinstance(s, S.Evaluate):
        Scope(env).expr(s.value)
    elif not isinstance(s, S.Empty):
        raise LoweringError(f"{type(s).__name__} has no plan here")


def count(env: Env, s: S.Do) -> None:
    """A counting loop: rows of a range if its body treats iterations alike, else driver-side scalars."""
    start, stop, step = constant(env, s.start), constant(env, s.stop), 1 if s.step is None else constant(env, s.step)
    low = s.var.lower()
    env.vars.setdefault(low, Scalar(start, "integer"))
    if s.cond is None:
        try:
            loop = Loop(env)
            loop.rows = env.catalog.spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").cast("int" if abs(stop) < 1 << 31 else "long").alias(f"do__{s.var}"))
            loop.scope.buffers["do"] = {low: f"do__{s.var}"}
            loop.scope.locals[low] = F.col(f"do__{s.var}")
            loop.keys, loop.levels, loop.columns = [f"do__{s.var}"], [1], [f"do__{s.var}"]
            if step < 0:
                loop.sort = [(F.col(f"do__{s.var}"), True)]
            before = dict(env.vars), list(env.rows)
            loop.block(s.body)
            loop.body(s.body)
            loop.finish()
            env.vars[low] = Scalar(start + max(0, (stop - start) // step + 1) * step, "integer")
            return
        except LoweringError:
            env.vars, env.rows = before
    i, turns = start, 0
    while (i <= stop if step > 0 else i >= stop) and (s.cond is None or constant(env, S.Choice(S.Literal(True), s.cond, s.cond))):
        env.vars[low] = Scalar(i, "integer")
        try:
            execute(env, s.body)
        except _Skip:
            pass
        except _Stop:
            return
        i, turns = constant(env, S.Name(s.var)) + step, turns + 1
        if turns > MOST_ITERATIONS:
            raise LoweringError(f"a loop took more than {MOST_ITERATIONS} iterations")
    env.vars[low] = Scalar(i, "integer")


#: Iterations of a driver-side scalar loop at most.
MOST_ITERATIONS = 1_000_000


def repeat(env: Env, s) -> None:
    """DO, DO WHILE and REPEAT over driver-side scalars: control flow, not data."""
    for _ in range(MOST_ITERATIONS):
        if s.cond is not None and not constant(env, s.cond):
            return
        try:
            execute(env, s.body)
        except _Skip:
            pass
        except _Stop:
            return
        if isinstance(s, S.Do) and s.cond is None:
            return
    raise LoweringError(f"a loop took more than {MOST_ITERATIONS} iterations")


def find(env: Env, s: S.Find) -> DataFrame:
    """A FIND at top level: at most one row, with the table's columns."""
    loop, b = Loop(env), s.buffer.lower()
    right, cond = loop.matching(s)
    names = loop.scope.buffers[b]
    rows = loop.with_lazies(right)
    rows = rows if cond is None else rows.where(cond)
    own = [names[c.lower()] for c in env.catalog.order_of(b)]
    if s.which in ("next", "prev"):
        now = env.records.get(b)
        if now is None:
            raise LoweringError(f"FIND {s.which} before a first {s.buffer}")
        here = F.broadcast(now.select(F.struct(*env.catalog.order_of(b)).alias("__here")))
        key = F.struct(*[F.col(c).alias(k) for c, k in zip(own, env.catalog.order_of(b))])
        rows = rows.crossJoin(here).where(key > F.col("__here") if s.which == "next" else key < F.col("__here"))
    down = s.which in ("last", "prev")
    if s.which == "unique":
        rows = rows.limit(2)
        n = F.count(F.lit(1)).over(Window.partitionBy())
        rows = rows.withColumn("__n", n)
        rows = rows.where("__n = 1") if s.no_error else rows.where(F.assert_true(F.col("__n") <= 1, F.lit(f"more than one {s.buffer}")).isNull())
    else:
        rows = rows.orderBy(*[F.col(c).desc() if down else F.col(c) for c in own]).limit(1)
    return rows.select(*[F.col(c).alias(c.split("__", 1)[1]) for c in names.values()])


def run_procedure(env: Env, s: S.Run) -> None:
    """RUN: a fresh scope with the parameters; output parameters are copied back."""
    name = _text_of(env, s.target)
    proc = env.procedures.get(name.lower())
    if proc is None:
        raise LoweringError(f"no procedure {name}")
    params = [p for p in proc.body if isinstance(p, S.Parameter)]
    if len(params) != len(s.args):
        raise LoweringError(f"{name} takes {len(params)} arguments")
    inner = Env(env.catalog, dict(env.vars), dict(env.types), env.procedures, env.rows, dict(env.records), None, env.functions, env.pending, env.paths)
    for p, (_, arg) in zip(params, s.args):
        inner.types[p.name.lower()] = p.type
        inner.vars[p.name.lower()] = Scalar(_DEFAULTS.get(p.type), p.type)
        if p.direction != "output":
            outside = Env(env.catalog, dict(env.vars), dict(env.types), env.procedures, [], env.records, None, env.functions)
            store(outside, S.Assign(S.Name("__arg"), arg), p.type)
            inner.vars[p.name.lower()] = outside.vars["__arg"]
    own = {p.name.lower() for p in params} | {d.name.lower() for d in proc.body if isinstance(d, S.Declare)}
    try:
        execute(inner, [x for x in proc.body if not isinstance(x, S.Parameter)])
    except _Done:
        env.returned = inner.returned
    for k, v in inner.vars.items():
        if k in env.vars and k not in own:
            env.vars[k] = v
    for p, (_, arg) in zip(params, s.args):
        if p.direction != "input":
            if not isinstance(arg, S.Name):
                raise LoweringError("an output argument must be a variable")
            env.vars[arg.name.lower()] = inner.vars[p.name.lower()]


def run(catalog: Catalog | SparkSession, text: str) -> Env:
    """Parse a program and lower it; the DataFrames of the returned environment are lazy."""
    env = Env(catalog if isinstance(catalog, Catalog) else Catalog(catalog))
    statements = parse(text)
    for s in statements:
        if isinstance(s, S.Procedure):
            env.procedures[s.name.lower()] = s
        elif isinstance(s, S.Function):
            env.functions[s.name.lower()] = s
    try:
        execute(env, statements)
    except _Done:
        pass
    flush(env)
    return env


def project(catalog: Catalog, buffer: str, where: str | None = None, **columns: str) -> DataFrame:
    """Rows of one table with columns given as expressions of the language."""
    loop = Loop(Env(catalog))
    loop.enter(S.ForEach(buffer, [], where=parse_expression(where) if where else None))
    return loop.rows.select(*[loop.scope.expr(parse_expression(e)).alias(n) for n, e in columns.items()])


__all__ = ["Env", "LoweringError", "Scalar", "Lazy", "run", "project"]
