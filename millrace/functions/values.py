"""Dialect expressions built in the host language: a Value stands for an expression over a table's columns.

    total = Value.column("price").multiply(Value.of(2)).is_greater(Value.of(10))
    df.filter(total.on(session))

Each method is a node of the dialect's own syntax tree, so its meaning (NULL is lowest, comparisons are two-valued)
is that of SQL text, and it becomes a Column of built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from millrace.dialect.tree import Call, Column, Expr, Literal


class Value:
    __slots__ = ("tree",)

    def __init__(self, tree: Expr) -> None:
        self.tree = tree

    @classmethod
    def column(cls, *path: str) -> Value:
        return cls(Column(path))

    @classmethod
    def of(cls, value) -> Value:
        if isinstance(value, Value):
            return value
        if value is None:
            return cls(Literal(None, "null"))
        if isinstance(value, bool):
            return cls(Literal(value, "boolean"))
        return cls(Literal(value, "string")) if isinstance(value, str) else cls(Literal(str(value), "number"))

    def _call(self, name: str, *others) -> Value:
        return Value(Call(name, (self.tree, *(Value.of(o).tree for o in others))))

    def on(self, session) -> SparkColumn:
        """The expression as a Column, under a session's rules and functions."""
        from millrace.plans.lower import Lower

        return F.expr(Lower(session, {}).expr(self.tree))

    def lower(self) -> Value:
        return self._call("lower")

    def upper(self) -> Value:
        return self._call("upper")

    def concat(self, *others) -> Value:
        return self._call("concat", *others)

    def trim(self, what: str = " ", side: str = "BOTH") -> Value:
        return Value(Call("trim", (Literal(side, "string"), Literal(what, "string"), self.tree)))

    def substring(self, start, length=None) -> Value:
        return self._call("substring", start) if length is None else self._call("substring", start, length)

    def abs(self) -> Value:
        return self._call("abs")

    def sign(self) -> Value:
        return self._call("sign")

    def sqrt(self) -> Value:
        return self._call("sqrt")

    def pow(self, exponent) -> Value:
        return self._call("pow", exponent)

    def round(self, scale=0) -> Value:
        return self._call("round", scale)

    def modulo(self, other) -> Value:
        return self._call("mod", other)

    def add(self, other) -> Value:
        return self._call("+", other)

    def subtract(self, other) -> Value:
        return self._call("-", other)

    def multiply(self, other) -> Value:
        return self._call("*", other)

    def divide(self, other) -> Value:
        return self._call("/", other)

    def both(self, other) -> Value:
        return self._call("AND", other)

    def either(self, other) -> Value:
        return self._call("OR", other)

    def negated(self) -> Value:
        return self._call("NOT")

    def same(self, other) -> Value:
        return self._call("IS", other)

    def differs(self, other) -> Value:
        return self._call("IS NOT", other)

    def equals(self, other) -> Value:
        return self._call("=", other)

    def is_less(self, other) -> Value:
        return self._call("<", other)

    def is_greater(self, other) -> Value:
        return self._call(">", other)

    def at_most(self, other) -> Value:
        return self._call("<=", other)

    def at_least(self, other) -> Value:
        return self._call(">=", other)

    __add__, __sub__, __mul__, __truediv__, __mod__ = add, subtract, multiply, divide, modulo
    __and__, __or__, __invert__ = both, either, negated
    __lt__, __gt__, __le__, __ge__ = is_less, is_greater, at_most, at_least
