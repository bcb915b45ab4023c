"""Comparisons with NULL as the lowest value: they are two-valued and agree with the sort order."""

from __future__ import annotations

OPPOSITE = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
MIRROR = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def value_form(op: str, a: str, b: str) -> str:
    """TRUE or FALSE, never NULL; usable anywhere."""
    return {
        "=": f"({a} <=> {b})",
        "<>": f"(NOT ({a} <=> {b}))",
        "<": f"coalesce({a} < {b}, {a} IS NULL AND {b} IS NOT NULL)",
        "<=": f"coalesce({a} <= {b}, {a} IS NULL)",
        ">": f"coalesce({a} > {b}, {a} IS NOT NULL AND {b} IS NULL)",
        ">=": f"coalesce({a} >= {b}, {b} IS NULL)",
    }[op]


def filter_form(op: str, a: str, b: str, literal: bool) -> str:
    """Where NULL and FALSE are alike (WHERE, ON, HAVING, through AND and OR). Against a literal that
    is not NULL it is a form that the Parquet reader takes as a pushed filter."""
    if literal:
        return {"=": f"({a} = {b})", "<>": f"({a} <> {b} OR {a} IS NULL)", "<": f"({a} < {b} OR {a} IS NULL)", "<=": f"({a} <= {b} OR {a} IS NULL)", ">": f"({a} > {b})", ">=": f"({a} >= {b})"}[op]
    return {
        "=": f"({a} <=> {b})",
        "<>": f"(NOT ({a} <=> {b}))",
        "<": f"({a} < {b} OR ({a} IS NULL AND {b} IS NOT NULL))",
        "<=": f"({a} <= {b} OR {a} IS NULL)",
        ">": f"({a} > {b} OR ({a} IS NOT NULL AND {b} IS NULL))",
        ">=": f"({a} >= {b} OR {b} IS NULL)",
    }[op]
