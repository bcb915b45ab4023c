"""Built-in functions of the dialect as Spark SQL text, keyed by name and number of arguments.

Everything lowers to built-in expressions, so it stays in generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Function:
    least: int
    most: float
    lower: Callable[..., str]
    aggregate: bool = False


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strict(name: str) -> Callable[..., str]:
    """LEAST and GREATEST are NULL if any argument is."""
    return lambda *a: f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE {name}({', '.join(a)}) END" if len(a) > 1 else a[0]


def _trim(side: str, what: str, text: str) -> str:
    """Strips repeated occurrences of a whole string, not of a set of characters."""
    side = side.strip("'")
    if len(what) == 3 and what[1] not in "\\'":  # one plain character
        return f"trim({side} {what} FROM {text})"
    quoted = f"concat('\\\\Q', {what}, '\\\\E')"
    lead, trail = f"concat('^(?:', {quoted}, ')+')", f"concat('(?:', {quoted}, ')+$')"
    cut = {"LEADING": lead, "TRAILING": trail, "BOTH": f"concat({lead}, '|', {trail})"}[side]
    return f"CASE WHEN {what} = '' THEN {text} ELSE regexp_replace({text}, {cut}, '') END"


def _substring(text: str, start: str, length: str | None = None) -> str:
    """1-based; a start below 1 counts as 1 and leaves the length alone; NULL arguments give NULL."""
    first = f"CASE WHEN {start} IS NULL THEN NULL ELSE greatest(CAST({start} AS INT), 1) END"
    if length is None:
        return f"substring({text}, {first})"
    return f"substring({text}, {first}, CASE WHEN {length} IS NULL THEN NULL ELSE greatest(CAST({length} AS INT), 0) END)"


def _strings(args: tuple[str, ...]) -> str:
    return ", ".join(f"CAST({a} AS STRING)" for a in args)


def group_concat(args: tuple[str, ...], distinct: bool, order: str = "") -> str:
    """Joins the non-null values with ', '; '' if there are none. Without an order of its own it
    sorts by the value, so that the result does not depend on partitions."""
    if len(args) == 1:
        value = f"CAST({args[0]} AS STRING)"
    else:
        value = f"CASE WHEN coalesce({_strings(args)}) IS NOT NULL THEN concat_ws(', ', {_strings(args)}) END"
    return f"coalesce(listagg({'DISTINCT ' if distinct else ''}{value}, ', ') WITHIN GROUP (ORDER BY {order or value}), '')"


INF = float("inf")
SCALARS: dict[str, Function] = {
    "abs": Function(1, 1, lambda x: f"abs({x})"),
    "sign": Function(1, 1, lambda x: f"CASE WHEN isnan({x}) THEN 1 ELSE CAST(signum({x}) AS INT) END"),
    "mod": Function(2, 2, lambda a, b: f"try_mod({a}, {b})"),
    "round": Function(1, 2, lambda x, d="0": f"round({x}, {d if d != 'NULL' else '0'})"),
    "pow": Function(2, 2, lambda a, b: f"power({a}, CAST({b} AS INT))"),
    "sqrt": Function(1, 1, lambda x: f"sqrt({x})"),
    "least": Function(1, INF, _strict("least")),
    "greatest": Function(1, INF, _strict("greatest")),
    "lower": Function(1, 1, lambda x: f"lower({x})"),
    "upper": Function(1, 1, lambda x: f"upper({x})"),
    "concat": Function(1, INF, lambda *a: f"concat_ws('', {_strings(a)})"),
    "length": Function(1, 1, lambda x: f"length({x})"),
    "char_length": Function(1, 1, lambda x: f"char_length({x})"),
    "octet_length": Function(1, 1, lambda x: f"octet_length({x})"),
    "bit_length": Function(1, 1, lambda x: f"bit_length({x})"),
    "trim": Function(3, 3, _trim),
    "ltrim": Function(1, 1, lambda x: f"ltrim({x})"),
    "rtrim": Function(1, 1, lambda x: f"rtrim({x})"),
    "substring": Function(2, 3, _substring),
    "if": Function(3, 3, lambda c, a, b: f"if({c}, {a}, {b})"),
    "current_date": Function(0, 0, lambda: "current_date()"),
    "current_time": Function(0, 0, lambda: "date_format(current_timestamp(), 'HH:mm:ss')"),
    "current_timestamp": Function(0, 0, lambda: "current_timestamp()"),
    "neg": Function(1, 1, lambda x: f"(- {x})"),
    "composite": Function(1, INF, lambda *a: f"struct({', '.join(f'{x} AS p{i}' for i, x in enumerate(a))})"),
    "composite_fetch": Function(2, 2, lambda c, i: f"({c}).p{int(i)}"),
}
AGGREGATES: dict[str, Function] = {
    "count": Function(1, 1, lambda x: f"count({x})", True),
    "min": Function(1, 1, lambda x: f"min({x})", True),
    "max": Function(1, 1, lambda x: f"max({x})", True),
    "sum": Function(1, 1, lambda x: f"sum({x})", True),
    "avg": Function(1, 1, lambda x: f"round(avg({x}), 10)", True),
    "group_concat": Function(1, INF, lambda *a: group_concat(a, False), True),
}
#: Spark's own aggregates, let through as extensions.
MORE_AGGREGATES = {"stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "median", "approx_count_distinct", "percentile", "percentile_approx", "any_value", "first", "last", "min_by", "max_by", "collect_list", "collect_set", "bool_and", "bool_or", "listagg", "corr", "mode"}
