"""Scalar functions by the language's names, each a builder of column expressions. Lists are delimited texts, positions count from 1."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnknownFunction(LookupError):
    """No such function, or one that has no meaning over tables (terminal, handles, reports)."""


def _text(x: Column) -> Column:
    return x.cast("string")


def _list(items: Column, sep: Column | None) -> Column:
    return F.split(items, F.concat(F.lit("\\Q"), F.lit(",") if sep is None else sep, F.lit("\\E")), -1)


def _entry(n: Column, items: Column, sep: Column | None = None) -> Column:
    return F.split_part(items, F.lit(",") if sep is None else sep, n.cast("int"))


def _num_entries(items: Column, sep: Column | None = None) -> Column:
    return F.when(items == "", F.lit(0)).otherwise(F.size(_list(items, sep)))


def _lookup(x: Column, items: Column, sep: Column | None = None) -> Column:
    return F.array_position(_list(items, sep), x).cast("int")


def _index(s: Column, t: Column, start: Column | None = None) -> Column:
    return F.call_function("locate", t, s, F.lit(1) if start is None else start.cast("int"))


def _r_index(s: Column, t: Column) -> Column:
    at = F.call_function("locate", F.reverse(t), F.reverse(s), F.lit(1))
    return F.when(at == 0, F.lit(0)).otherwise(F.length(s) - at - F.length(t) + 2)


def _substring(s: Column, start: Column, n: Column | None = None) -> Column:
    return F.substring(s, start.cast("int"), F.lit(2147483647) if n is None else n.cast("int"))


def _overlay(s: Column, start: Column, n: Column, new: Column) -> Column:
    return F.overlay(s, new, start.cast("int"), n.cast("int"))


def _truncate(x: Column, n: Column) -> Column:
    p = F.pow(F.lit(10.0), n)
    return F.signum(x) * F.floor(F.abs(x) * p) / p


def _round(x: Column, n: Column) -> Column:
    return F.call_function("round", x, n.cast("int"))


def _random(a: Column, b: Column) -> Column:
    return (F.floor(F.rand() * (b - a + 1)) + a).cast("int")


def _mtime(t: Column | None = None) -> Column:
    t = F.localtimestamp() if t is None else t
    return ((F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) * 1000).cast("int")


_UNITS = {"year": "YEAR", "month": "MONTH", "week": "WEEK", "day": "DAY", "hour": "HOUR", "minute": "MINUTE", "second": "SECOND", "millisecond": "MILLISECOND"}


def _unit(unit) -> str:
    word = str(unit).strip().lower().rstrip("s")
    if word not in _UNITS:
        raise UnknownFunction(f"interval unit {unit!r}")
    return _UNITS[word]


def _add_interval(t: Column, n: Column, unit: str) -> Column:
    return F.timestamp_add(_unit(unit), n.cast("int"), t)


def _interval(later: Column, earlier: Column, unit: str) -> Column:
    """later minus earlier in whole units."""
    return F.timestamp_diff(_unit(unit), earlier, later)


def _date(*args: Column) -> Column:
    return args[0].cast("date") if len(args) == 1 else F.make_date(args[2].cast("int"), args[0].cast("int"), args[1].cast("int"))


def _datetime(m: Column, d: Column, y: Column, h: Column | None = None, mi: Column | None = None, s: Column | None = None) -> Column:
    zero = F.lit(0)
    return F.make_timestamp_ntz(y, m, d, zero if h is None else h, zero if mi is None else mi, zero if s is None else s)


def _encode(x: Column) -> Column:
    return F.base64(F.unhex(F.sha2(x, 256)))


def _fold(f):
    return lambda *xs: xs[0] if len(xs) == 1 else f(*xs)


def _logical(x: Column, *_: Column) -> Column:
    return F.when(F.lower(_text(x)).isin("yes", "true"), True).when(F.lower(_text(x)).isin("no", "false"), False)


_BEGAN = time.monotonic()


def formatted(x: Column, form: str, kind: str) -> Column:
    """A value as a DISPLAY format shows it: x(n) cuts texts, 9, > and commas shape numbers, 99 and 9999 dates, a/b logicals."""
    if kind == "boolean" and "/" in form:
        yes, no = form.split("/", 1)
        return F.when(x, yes).when(~x, no)
    if kind.startswith(("date", "timestamp")):
        parts = re.findall("9+", form)
        first = form[len(parts[0])] if len(parts) > 1 else "/"
        names = ("yyyy", "MM", "dd") if len(parts[0]) == 4 else ("MM", "dd", "yyyy" if len(parts) > 2 and len(parts[2]) == 4 else "yy")
        return F.date_format(x, first.join(names[: len(parts)]))
    if kind == "string":
        m = re.fullmatch(r"[xX]\((\d+)\)|([xX]+)", form)
        if m is None:
            raise UnknownFunction(f"format {form!r} of a text")
        return F.left(x, F.lit(int(m[1]) if m[1] else len(m[2])))
    whole, _, part = re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), form).partition(".")
    if "," in whole:
        return F.format_number(x, len(part))
    return F.format_string(f"%0{max(1, whole.count('9')) + (len(part) + 1 if part else 0)}.{len(part)}f", x.cast("double"))


#: Name, with both long and short spellings, to builder.
FUNCTIONS = {
    # text
    "trim": F.trim, "left-trim": F.ltrim, "right-trim": F.rtrim, "caps": F.upper, "upper": F.upper, "lc": F.lower, "lower": F.lower,
    "length": lambda s, *_: F.length(s), "substring": _substring, "substr": _substring, "overlay": _overlay, "replace": lambda s, a, b: F.replace(s, a, b),
    "entry": _entry, "num-entries": _num_entries, "lookup": _lookup, "index": _index, "r-index": _r_index, "fill": lambda s, n: F.repeat(s, n.cast("int")),
    "string": lambda x, *_: _text(x), "quoter": lambda s: F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')), "chr": lambda n: F.char(n.cast("int")), "asc": F.ascii,
    "encode": _encode, "concat": F.concat,
    # numbers
    "abs": F.abs, "absolute": F.abs, "round": _round, "truncate": _truncate, "trunc": _truncate, "sqrt": F.sqrt, "exp": lambda b, e: F.pow(b, e),
    "log": lambda x, *b: F.call_function("log", b[0], x) if b else F.ln(x), "minimum": _fold(F.least), "min": _fold(F.least), "maximum": _fold(F.greatest), "max": _fold(F.greatest),
    "random": _random, "integer": lambda x: x.cast("int"), "int": lambda x: x.cast("int"), "int64": lambda x: x.cast("long"), "decimal": lambda x: x.cast("decimal(38,10)"), "dec": lambda x: x.cast("decimal(38,10)"),
    "logical": _logical, "to-rowid": lambda x: x.cast("long"),
    # dates
    "today": F.current_date, "now": F.localtimestamp, "year": F.year, "month": F.month, "day": F.day, "weekday": F.dayofweek, "mtime": _mtime, "etime": lambda *_: F.lit(int((time.monotonic() - _BEGAN) * 1000)),
    "time": lambda: (_mtime() / 1000).cast("int"), "date": _date, "datetime": _datetime, "add-interval": _add_interval, "interval": _interval,
    # session
    "userid": F.current_user, "dbname": F.current_database, "ldbname": lambda *_: F.current_database(), "pdbname": lambda *_: F.current_database(), "dbversion": lambda *_: F.version(), "proversion": F.version,
    "dbtype": lambda *_: F.lit("spark"), "sdbname": lambda *_: F.current_database(), "alias": lambda *_: F.current_catalog(), "opsys": lambda: F.lit("JVM"), "connected": lambda *_: F.lit(True), "num-dbs": lambda: F.lit(1), "num-aliases": lambda: F.lit(0),
}

#: Functions whose last argument is a literal word, not a column.
WORD_LAST = {"add-interval", "interval"}


def call(name: str, args: list, word: str | None = None) -> Column:
    """The column of a call; word: the literal last argument of the functions in WORD_LAST."""
    builder = FUNCTIONS.get(name.lower())
    if builder is None:
        raise UnknownFunction(f"function {name} has no meaning over tables")
    return builder(*args, word) if word is not None else builder(*args)
