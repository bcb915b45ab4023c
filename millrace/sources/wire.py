"""A statement and its parameters as bytes, to send or to keep: version, text and values as JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal

VERSION = 1
#: How values that JSON lacks are written, and read back.
_KINDS = {
    "decimal": (Decimal, str, Decimal),
    "timestamp": (datetime, datetime.isoformat, datetime.fromisoformat),
    "date": (date, date.isoformat, date.fromisoformat),
    "binary": (bytes, bytes.hex, bytes.fromhex),
}


def _out(value):
    for kind, (cls, write, _) in _KINDS.items():
        if isinstance(value, cls):
            return {"kind": kind, "value": write(value)}
    return value


def _in(value):
    return _KINDS[value["kind"]][2](value["value"]) if isinstance(value, dict) else value


def packed(text: str, params: Sequence | Mapping | None = None) -> bytes:
    values = {k: _out(v) for k, v in params.items()} if isinstance(params, Mapping) else [_out(v) for v in params or ()]
    return json.dumps({"version": VERSION, "text": text, "params": values}).encode()


def unpacked(data: bytes) -> tuple[str, list | dict]:
    found = json.loads(data)
    if found.get("version") != VERSION:
        raise ValueError(f"version {found.get('version')} is not known")
    params = found["params"]
    return found["text"], {k: _in(v) for k, v in params.items()} if isinstance(params, dict) else [_in(v) for v in params]
