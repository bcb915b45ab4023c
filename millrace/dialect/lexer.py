"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class DialectError(ValueError):
    """A statement that the dialect does not allow."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, number, string, op, end
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


_PATTERN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|//[^\n]*)
  | (?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
  | (?P<string>'(?:[^'\\]|''|\\.)*')
  | (?P<quoted>"(?:[^"]|"")+")
  | (?P<name>[A-Za-z_\#][A-Za-z0-9_$\#]*)
  | (?P<op><=>|<>|!=|==|<=|>=|\|\||[-+*/%=<>(),.;?:@])""",
    re.X | re.S,
)

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _PATTERN.match(sql, at)
        if not m:
            raise DialectError(f"unexpected {sql[at]!r} at {at}")
        kind = m.lastgroup
        if kind == "string":
            body = re.sub(r"''|\\(.)", lambda e: "'" if e[1] is None else _ESCAPES.get(e[1], e[1] if e[1] in "\\'" else "\\" + e[1]), m[0][1:-1], flags=re.S)
            out.append(Token("string", body, at))
        elif kind == "quoted":
            out.append(Token("quoted", m[0][1:-1].replace('""', '"'), at))
        elif kind != "skip":
            out.append(Token(kind, m[0], at))
        at = m.end()
    out.append(Token("end", "", len(sql)))
    return out
