"""An expression and the input's schema to a column.

Decisions (the language has no errors at run time):

* integers are 64 bits wide; overflow gives null;
* integer / integer truncates toward zero, null for a zero divisor; otherwise division follows IEEE 754;
* + joins two strings; other mixes of strings and numbers are type errors when the pipeline is built.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..lang import tree as T
from ..lang.errors import ScriptError, unknown_column

WHOLE = (S.ByteType, S.ShortType, S.IntegerType, S.LongType)
REAL = (S.FloatType, S.DoubleType)
_TRY = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(kind: S.DataType) -> bool:
    return isinstance(kind, S.NumericType)


def literal(value) -> tuple[Column, S.DataType]:
    if isinstance(value, bool):
        return F.lit(value), S.BooleanType()
    if isinstance(value, int):
        return F.lit(value).cast("long"), S.LongType()
    if isinstance(value, float):
        return F.lit(value), S.DoubleType()
    return F.lit(value), S.StringType()


def compile_expr(expr: T.Expr, schema: S.StructType) -> tuple[Column, S.DataType]:
    if isinstance(expr, T.Lit):
        return literal(expr.value)
    if isinstance(expr, T.Col):
        if expr.name not in schema.names:
            raise unknown_column(expr.name, schema.names)
        return column(expr.name), schema[expr.name].dataType
    a, ka = compile_expr(expr.left, schema)
    b, kb = compile_expr(expr.right, schema)
    text = [isinstance(k, S.StringType) for k in (ka, kb)]
    if any(text) and not all(text) and (is_number(ka) or is_number(kb) or isinstance(ka, S.BooleanType) or isinstance(kb, S.BooleanType)):
        raise ScriptError("type", f"'{expr.op}' between {ka.simpleString()} and {kb.simpleString()}", hint="use cast first")
    if expr.op in ("==", "!=", "<", ">", "<=", ">="):
        out = {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[expr.op]
        return out, S.BooleanType()
    if all(text):
        if expr.op != "+":
            raise ScriptError("type", f"'{expr.op}' between strings")
        return F.concat(a, b), S.StringType()
    if not (is_number(ka) and is_number(kb)):
        raise ScriptError("type", f"'{expr.op}' between {ka.simpleString()} and {kb.simpleString()}")
    whole = isinstance(ka, WHOLE) and isinstance(kb, WHOLE)
    kind = S.LongType() if whole else S.DoubleType()
    a, b = a.cast(kind), b.cast(kind)
    if expr.op != "/":
        return (_TRY[expr.op](a, b) if whole else {"+": a + b, "-": a - b, "*": a * b}[expr.op]), kind
    if whole:
        return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long"))), kind
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    by_zero = F.when(a.isNull(), F.lit(None).cast("double")).when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b)), kind
