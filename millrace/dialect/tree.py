"""Syntax tree. Nodes are immutable and compare by value, so a select output can be matched with a group key."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: object
    kind: str  # number, string, boolean, null


@dataclass(frozen=True)
class Column(Expr):
    path: tuple[str, ...]


@dataclass(frozen=True)
class Star(Expr):
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Call(Expr):
    """A function; operators are calls named by their sign."""

    name: str
    args: tuple = ()
    distinct: bool = False
    star: bool = False
    order: tuple = ()


@dataclass(frozen=True)
class Over(Expr):
    """A call over a window of rows; frame: the bounds of ROWS, or None."""

    call: Call
    partition: tuple = ()
    order: tuple = ()
    frame: tuple[str, str] | None = None


@dataclass(frozen=True)
class Cast(Expr):
    value: Expr
    type: str
    size: tuple[int, ...] = ()


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    whens: tuple
    otherwise: Expr | None


@dataclass(frozen=True)
class Quantified(Expr):
    """left op ANY/ALL (query or list); IN is = ANY and NOT IN is <> ALL."""

    left: Expr
    op: str
    every: bool
    query: object | None
    values: tuple = ()


@dataclass(frozen=True)
class Exists(Expr):
    query: object
    negated: bool = False


@dataclass(frozen=True)
class Scalar(Expr):
    query: object


@dataclass(frozen=True)
class Table:
    path: tuple[str, ...]
    alias: str | None = None


@dataclass(frozen=True)
class Derived:
    query: object
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    kind: str  # inner, left, right, full, cross
    on: Expr | None = None
    using: tuple[str, ...] = ()
    natural: bool = False


@dataclass(frozen=True)
class Output:
    expr: Expr
    alias: str | None
    source: str


@dataclass(frozen=True)
class Order:
    expr: Expr
    ascending: bool = True
    nulls: str | None = None


@dataclass(frozen=True)
class Select:
    outputs: tuple[Output, ...]
    tables: tuple = ()
    where: Expr | None = None
    group: tuple = ()
    having: Expr | None = None
    distinct: bool = False


@dataclass(frozen=True)
class SetOp:
    left: object
    right: object
    op: str
    all: bool = False


@dataclass(frozen=True)
class Query:
    body: object
    order: tuple[Order, ...] = ()
    limit: Expr | None = None
    offset: Expr | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    size: tuple[int, ...] = ()
    not_null: bool = False
    default: Expr | None = None
    default_source: str | None = None
    unique: bool = False
    primary: bool = False
    collate: str | None = None


@dataclass(frozen=True)
class Constraint:
    kind: str  # primary, unique, check, foreign
    name: str | None
    columns: tuple[str, ...] = ()
    check: Expr | None = None
    check_source: str | None = None
    target: tuple[str, ...] = ()
    target_columns: tuple[str, ...] = ()
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    deferrable: str = ""


@dataclass(frozen=True)
class Statement:
    kind: str
    data: dict = field(default_factory=dict, hash=False)
