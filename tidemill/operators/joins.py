"""Equi-joins with one layout of columns: left columns, then right ones; a right name that is taken gets ``_right``.

Inner and left joins drop the right keys, outer joins keep both sides' keys.  Null keys match nothing.
No side is broadcast by hint: Spark picks the strategy from sizes at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..functions.expressions import column
from ..lang import tree as T
from ..lang.errors import ScriptError, unknown_column


def join(left: DataFrame, right: DataFrame, op: T.Op) -> DataFrame:
    mine, theirs = op.on or op.left_on or (), op.on or op.right_on or ()
    if op.how == "cross" and mine:
        raise ScriptError("name", "a cross join has no keys", op.line)
    if op.how != "cross" and not mine:
        raise ScriptError("name", f"{op.how} join without keys", op.line)
    for names, df in ((mine, left), (theirs, right)):
        for k in names:
            if k not in df.columns:
                raise unknown_column(k, df.columns)
    inner = {c: f"__r_{c}" for c in right.columns}  # apart from the left names, also when a table is joined to itself
    other = right.toDF(*inner.values())
    if op.how == "cross":
        both = left.crossJoin(other)
    else:
        match = reduce(lambda a, b: a & b, [left[f"`{m}`"] == column(inner[t]) for m, t in zip(mine, theirs, strict=True)])
        both = left.join(other, match, {"inner": "inner", "left": "left", "outer": "full"}[op.how])
    out, taken = [column(c) for c in left.columns], set(left.columns)
    for c in right.columns:
        if op.how in ("inner", "left") and c in theirs:
            continue
        name = f"{c}_right" if c in taken else c
        if name in taken:
            raise ScriptError("name", f"join gives the column '{name}' twice", op.line)
        taken.add(name)
        out.append(column(inner[c]).alias(name))
    return both.select(*out)
