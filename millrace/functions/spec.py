"""The mini-language of function definitions:  [DETERMINISTIC|VOLATILE] type name(type [T] [?+*], ...)."""

from __future__ import annotations

import re
from dataclasses import dataclass

SPARK_TYPES = {"NUMERIC": "double", "STRING": "string", "BOOLEAN": "boolean", "BINARY": "binary", "DATE": "timestamp_ntz", "OBJECT": "string", "ANY": "string", "COMPARABLE": "string", "NULL": "void"}
KINDS = set(SPARK_TYPES) | {"COMPOSITE", "TABLE"}


@dataclass(frozen=True)
class Parameter:
    kinds: tuple[str, ...]
    same: bool  # tagged T: the return type follows it
    often: str  # "", "?", "+", "*"


@dataclass(frozen=True)
class Spec:
    name: str
    returns: str
    parameters: tuple[Parameter, ...]
    deterministic: bool = True

    @property
    def least(self) -> int:
        return sum(p.often in ("", "+") for p in self.parameters)

    @property
    def most(self) -> float:
        return float("inf") if any(p.often in ("+", "*") for p in self.parameters) else len(self.parameters)

    def takes(self, n: int) -> bool:
        return self.least <= n <= self.most


def parse_spec(text: str) -> Spec:
    m = re.fullmatch(r"\s*(?:(DETERMINISTIC|VOLATILE)\s+)?([A-Z]+|T)\s+(\w+)\s*\((.*)\)\s*", text, re.S | re.I)
    if not m:
        raise ValueError(f"not a function definition: {text!r}")
    params = []
    for part in filter(None, (p.strip() for p in m[4].split(","))):
        q = re.fullmatch(r"(?:<([A-Z|\s]+)>|([A-Z]+))\s*(T)?\s*([?+*])?", part, re.I)
        if not q:
            raise ValueError(f"not a parameter: {part!r}")
        kinds = tuple(k.strip().upper() for k in (q[1] or q[2]).split("|"))
        if not set(kinds) <= KINDS:
            raise ValueError(f"no such type in {part!r}")
        params.append(Parameter(kinds, bool(q[3]), q[4] or ""))
    returns = m[2].upper()
    if returns != "T" and returns not in KINDS:
        raise ValueError(f"no such type: {returns}")
    return Spec(m[3].lower(), returns, tuple(params), (m[1] or "DETERMINISTIC").upper() == "DETERMINISTIC")


def parse_sets(text: str) -> list[tuple[bool, str, list[Spec]]]:
    """Sets of definitions,  FUNCTION|AGGREGATE name { definition; ... } ...,  as (is aggregate, name, specs)."""
    out, at = [], 0
    head = re.compile(r"\s*(FUNCTION|AGGREGATE)\s+([\w.]+)\s*\{([^}]*)\}", re.I)
    while m := head.match(text, at):
        out.append((m[1].upper() == "AGGREGATE", m[2], [parse_spec(p) for p in m[3].split(";") if p.strip()]))
        at = m.end()
    if text[at:].strip():
        raise ValueError(f"not a set of definitions: {text[at:].strip()[:40]!r}")
    return out
