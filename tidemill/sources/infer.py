"""Types of text cells, and a ``type`` declaration for a CSV file."""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterable

_INT = re.compile(r"[+-]?\d+$")
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$", re.I)
ROWS = 100


def cell_type(value: str) -> str:
    v = value.strip().lower()
    if v in ("true", "false"):
        return "bool"
    if _INT.match(v) and -(2**63) <= int(v) < 2**63:
        return "int"
    return "float" if _FLOAT.match(v) else "string"


def merged(kinds: Iterable[str]) -> str:
    """The one type for cells of several: int and float give float, any other mix gives string."""
    found = set(kinds)
    if len(found) == 1:
        return found.pop()
    return "float" if found == {"int", "float"} else "string"


def field_types(header: list[str], rows: Iterable[list[str]]) -> list[tuple[str, str]]:
    kinds: list[set[str]] = [set() for _ in header]
    blank = [False] * len(header)
    for row in rows:
        for k, _ in enumerate(header):
            cell = row[k] if k < len(row) else ""
            if cell.strip():
                kinds[k].add(cell_type(cell))
            else:
                blank[k] = True
    out = []
    for name, found, empty in zip(header, kinds, blank, strict=True):
        kind = merged(found) if found else "string"
        out.append((name.strip(), f"Option<{kind}>" if empty and found else kind))
    return out


def type_name(path: str) -> str:
    stem = os.path.splitext(os.path.basename(path))[0]
    return "".join(part[0].upper() + part[1:] for part in re.split(r"[_-]", stem) if part)


def variable_name(path: str) -> str:
    stem = os.path.splitext(os.path.basename(path))[0]
    parts = stem.split("_")
    if len(parts) < 2:
        return stem.lower()
    last = parts[-1]
    return (last if len(last) >= 2 and not last.isdigit() else parts[-2]).lower()


def decode(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp949", "replace")


def declaration(path: str, raw: bytes, nullable: bool = True) -> str:
    """The ``type`` and ``load`` lines for a CSV file's bytes."""
    rows = csv.reader(io.StringIO(decode(raw)))
    header = next(rows, [])
    fields = field_types(header, (r for _, r in zip(range(ROWS), rows, strict=False)))
    if not nullable:
        fields = [(n, re.sub(r"Option<(\w+)>", r"\1", t)) for n, t in fields]
    body = "".join(f"  {n}: {t},\n" for n, t in fields)
    return f'type {type_name(path)} = {{\n{body}}}\n\nv {variable_name(path)} = load("{path}") :: {type_name(path)}\n'
