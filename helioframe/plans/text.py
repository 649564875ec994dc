"""Small pieces of SQL text: parameter marks, ORDER BY lists, column definitions, sizes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|%\((\w+)\)s|%s|%%")


def bind_marks(query: str, params: Any) -> tuple[str, Any]:
    """A query with %s or %(name)s marks as one with ? or :name, and its arguments. Without parameters the text is left alone."""
    if params is None:
        return query, None

    def mark(m: re.Match) -> str:
        text = m[0]
        if m[1]:
            return f":{m[1]}"
        return {"%s": "?", "%%": "%"}.get(text, text.replace("%%", "%"))

    return _TOKEN.sub(mark, query), dict(params) if isinstance(params, dict) else list(params)


def split_list(text: str) -> list[str]:
    """The items of a list at commas outside quotes and brackets."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, text[start:]] if x.strip()]


_ORDER = re.compile(r"^(?P<by>.+?)(?:\s+(?P<way>ASC|DESC))?(?:\s+NULLS\s+(?P<nulls>FIRST|LAST))?$", re.I | re.S)


def ordering(order_by: str) -> list[Column]:
    """Sort columns of an ORDER BY list; unless stated, nulls count as greater than all values."""
    out = []
    for item in split_list(order_by):
        m = _ORDER.match(item)
        down, first = (m["way"] or "").upper() == "DESC", (m["nulls"] or "").upper()
        by, first = F.expr(m["by"]), first == "FIRST" if first else down
        out.append((by.desc_nulls_first() if first else by.desc_nulls_last()) if down else (by.asc_nulls_first() if first else by.asc_nulls_last()))
    return out


#: Type names of column definitions and what stores them. Fixed values.
TYPES = {
    "SERIAL": "INT", "BIGSERIAL": "BIGINT", "SMALLSERIAL": "SMALLINT",
    "TEXT": "STRING", "UUID": "STRING", "TIME": "STRING", "XML": "STRING", "INET": "STRING",
    "JSON": "VARIANT", "JSONB": "VARIANT",
    "INTEGER": "INT", "INT": "INT", "INT4": "INT", "INT2": "SMALLINT", "INT8": "BIGINT", "BIGINT": "BIGINT", "SMALLINT": "SMALLINT",
    "FLOAT": "DOUBLE", "FLOAT8": "DOUBLE", "FLOAT4": "FLOAT", "REAL": "FLOAT", "DOUBLE PRECISION": "DOUBLE", "DOUBLE": "DOUBLE",
    "NUMERIC": "DECIMAL(38,18)", "DECIMAL": "DECIMAL(38,18)",
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "DATE": "DATE", "BYTEA": "BINARY",
    "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP", "TIMESTAMP WITH TIME ZONE": "TIMESTAMP",
    "INTERVAL": "INTERVAL DAY TO SECOND",
}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    not_null: bool = False
    unique: bool = False
    serial: bool = False
    default: str | None = None
    references: str | None = None


_NAME = re.compile(r"\s*(double precision|timestamp with(?:out)? time zone|\w+)\s*(\(\s*\d+\s*(?:,\s*\d+\s*)?\))?\s*(\[\s*\])?", re.I)


def column_spec(name: str, definition: str) -> ColumnSpec:
    """A column definition (type and constraints) as what the engine stores and checks. Unknown types are refused."""
    m = _NAME.match(definition)
    kind, size, rest = (m[1].upper(), (m[2] or "").replace(" ", ""), definition[m.end() :]) if m else ("", "", "")
    if kind in ("VARCHAR", "CHAR", "CHARACTER") or (kind in ("NUMERIC", "DECIMAL") and size):
        stored = ({"NUMERIC": "DECIMAL"}.get(kind, kind) + size) if size else "STRING"
        stored = stored.replace("CHARACTER", "CHAR")
    elif kind in TYPES:
        stored = TYPES[kind]
    else:
        raise ValueError(f"unknown type in definition of column {name!r}: {definition!r}")
    key, serial = bool(re.search(r"\bPRIMARY\s+KEY\b", rest, re.I)), kind.endswith("SERIAL")
    default = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|[\w.]+\s*\([^)]*\)|[^\s,]+)", rest, re.I)
    value = default[1] if default else None
    if value and re.fullmatch(r"now\s*\(\s*\)|current_timestamp(\(\))?", value, re.I):
        value = "localtimestamp()" if stored == "TIMESTAMP_NTZ" else "current_timestamp()"
    other = re.search(r"\bREFERENCES\s+([\w.]+)", rest, re.I)
    return ColumnSpec(name, f"ARRAY<{stored}>" if m[3] else stored, key or serial or bool(re.search(r"\bNOT\s+NULL\b", rest, re.I)), key or bool(re.search(r"\bUNIQUE\b", rest, re.I)), serial, value, other[1].lower() if other else None)


def pretty_size(n: int) -> str:
    """Bytes below 10 kB as they are, then rounded in the largest unit that keeps the figure under 10240."""
    if abs(n) < 10 * 1024:
        return f"{n} bytes"
    for unit in ("kB", "MB", "GB", "TB"):
        n = (n + (512 if n > 0 else -512)) // 1024
        if abs(n) < 10 * 1024 or unit == "TB":
            return f"{n} {unit}"
    return ""
