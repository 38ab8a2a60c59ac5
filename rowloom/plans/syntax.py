"""Syntax trees of programs."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Unknown:
    """The unknown value."""


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    """qualifier.field; the qualifier may itself hold a database name."""

    qualifier: str
    name: str


@dataclass(frozen=True)
class Unary:
    op: str
    value: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Choice:
    """IF cond THEN yes ELSE no."""

    cond: object
    yes: object
    no: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Member:
    """value:name or, with args, value:name(args)."""

    value: object
    name: str
    args: tuple | None = None


@dataclass(frozen=True)
class Index:
    value: object
    index: object


@dataclass(frozen=True)
class CanFind:
    find: object


@dataclass
class Declare:
    name: str
    type: str
    initial: object = None
    extent: int | None = None
    no_undo: bool = False
    like: object = None


@dataclass
class Assign:
    target: object
    value: object


@dataclass
class Evaluate:
    value: object


@dataclass
class Do:
    body: list
    var: str | None = None
    start: object = None
    stop: object = None
    step: object = None
    cond: object = None


@dataclass
class If:
    cond: object
    yes: list
    no: list = field(default_factory=list)


@dataclass
class Transaction:
    """DO TRANSACTION, or ON ERROR UNDO: a body whose changes of variables and tables an UNDO takes back; handlers for errors."""

    body: list
    catches: list = field(default_factory=list)
    finally_: list = field(default_factory=list)


@dataclass
class Undo:
    leave: bool = True


@dataclass
class TempTable:
    name: str
    fields: list
    order: tuple = ()
    like: str | None = None


@dataclass
class BufferFor:
    name: str
    table: str


@dataclass
class DataSet:
    name: str
    tables: list
    relations: list


@dataclass
class Create:
    buffer: str


@dataclass
class Delete:
    buffer: str


@dataclass
class Release:
    buffer: str


@dataclass
class EmptyTable:
    name: str


@dataclass
class Function:
    name: str
    type: str
    params: list
    body: list


@dataclass
class Select:
    """A query as the texts of its tokens; into: variables that take its only row."""

    tokens: list
    into: list


@dataclass
class Stream:
    """INPUT FROM or OUTPUT TO a path, or its close (None)."""

    direction: str
    path: object


@dataclass
class Export:
    items: list
    delimiter: str = " "


@dataclass
class Import:
    buffer: str
    delimiter: str = " "


@dataclass
class Repeat:
    body: list
    cond: object = None


@dataclass
class ForEach:
    buffer: str
    body: list
    of: str | None = None
    where: object = None
    lock: str = "ShareLock"
    by: list = field(default_factory=list)
    breaks: bool = False
    which: str = "each"
    skip: int = 0


@dataclass
class Find:
    buffer: str
    which: str = "unique"
    key: object = None
    of: str | None = None
    where: object = None
    lock: str = "ShareLock"
    no_error: bool = False


@dataclass
class Case:
    value: object
    branches: list
    otherwise: list = field(default_factory=list)


@dataclass
class Procedure:
    name: str
    body: list


@dataclass
class Parameter:
    direction: str
    name: str
    type: str


@dataclass
class Run:
    target: object
    args: list


@dataclass
class Leave:
    pass


@dataclass
class Next:
    pass


@dataclass
class Return:
    value: object = None


@dataclass
class Empty:
    pass


@dataclass
class Display:
    """Projection: (expression, label, format) each; a record's name stands for its fields but those of besides."""

    items: list
    besides: tuple = ()


@dataclass
class Accumulate:
    """Aggregates of one expression: which of total, count, average, minimum, maximum."""

    value: object
    kinds: list
