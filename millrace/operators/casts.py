"""CAST with the dialect's guards: what cannot be read is NULL, too long text from another type is NULL."""

from __future__ import annotations

import re

_DATES = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "HH:mm:ss")


#: NUMERIC without a size: exact, with the scale of the dialect's division and room for any bigint.
NUMERIC = "decimal(29,10)"


def spark_type(kind: str, size: tuple[int, ...]) -> str:
    if kind == "decimal":
        return f"decimal({size[0]},{size[1] if len(size) > 1 else 0})" if size else NUMERIC
    return {"timestamp": "timestamp_ntz"}.get(kind, kind)


def cast(value: str, kind: str, size: tuple[int, ...], source: str | None) -> str:
    """source: Spark's type of the value as far as it is known."""
    source = (source or "").lower()
    if kind == "boolean":
        if source == "boolean":
            return value
        if source == "string":
            return f"CASE lower({value}) WHEN 'true' THEN true WHEN 'false' THEN false END"
        return f"CASE WHEN CAST({value} AS DOUBLE) = 0 THEN false WHEN CAST({value} AS DOUBLE) = 1 THEN true END"
    if kind == "string":
        text = f"date_format({value}, 'yyyy-MM-dd HH:mm:ss.S')" if source.startswith("timestamp") else f"CAST({value} AS STRING)"
        if not size:
            return text
        if source == "string":
            return f"substring({text}, 1, {size[0]})"
        return f"CASE WHEN char_length({text}) <= {size[0]} THEN {text} END"
    if kind == "timestamp":
        if source in ("", "string"):
            return "coalesce(" + ", ".join(f"CAST(try_to_timestamp({value}, '{f}') AS timestamp_ntz)" for f in _DATES) + ")"
        return f"CAST({value} AS timestamp_ntz)"
    if kind == "binary":
        return f"CAST({value} AS BINARY)"
    return f"try_cast({value} AS {spark_type(kind, size)})"


_WHOLE = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def exact(kind: str | None) -> tuple[int, int] | None:
    """(precision, scale) of an exact numeric type of Spark, None for any other."""
    m = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind or "")
    return (int(m[1]), int(m[2])) if m else (_WHOLE[kind], 0) if kind in _WHOLE else None


def divided(a: str, b: str, left: str | None, right: str | None) -> str:
    """The quotient to 10 decimals, half up. Exact operands give NULL on a zero divisor, others NaN.

    Spark's quotient of decimal(p,s) and decimal(q,t) has 10 decimals where p - s + t = 28 and q >= 9 - s, so the
    operands are cast to such types and the quotient is rounded once.
    """
    x, y = exact(left), exact(right)
    if not x or not y:
        return f"CASE WHEN {a} IS NOT NULL AND {b} = 0 THEN double('NaN') ELSE round(try_divide({a}, {b}), 10) END"
    p, s = min(38, 28 - y[1] + x[1]), x[1]
    q = max(y[0], 10)
    return f"try_divide(try_cast({a} AS decimal({p},{s})), CAST({b} AS decimal({q},{y[1]})))"
