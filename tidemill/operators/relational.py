"""One function per step: (DataFrame, step, pending group key) -> DataFrame."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.expressions import REAL, WHOLE, column, compile_expr, is_number
from ..lang import tree as T
from ..lang.errors import ScriptError, unknown_column
from . import ranks

CASTS = {"float": "double", "int": "bigint", "str": "string", "bool": "boolean"}


def known(df: DataFrame, name: str) -> S.DataType:
    if name not in df.columns:
        raise unknown_column(name, df.columns)
    return df.schema[name].dataType


def filter_(df: DataFrame, op: T.Op) -> DataFrame:
    where, kind = compile_expr(op.where, df.schema)
    if not isinstance(kind, S.BooleanType):
        raise ScriptError("type", f"filter needs a condition, not {kind.simpleString()}", op.line)
    return df.filter(where)


def select(df: DataFrame, op: T.Op) -> DataFrame:
    if len(set(op.columns)) < len(op.columns):
        raise ScriptError("name", "select names a column twice", op.line)
    for c in op.columns:
        known(df, c)
    return df.select(*[column(c) for c in op.columns])


def order_by(df: DataFrame, op: T.Op) -> DataFrame:
    known(df, op.column)
    c = column(op.column)
    return df.orderBy(c.desc_nulls_first() if op.desc else c.asc_nulls_first())


def take(df: DataFrame, op: T.Op) -> DataFrame:
    return df.limit(op.n)


def drop_null(df: DataFrame, op: T.Op) -> DataFrame:
    known(df, op.column)
    return df.filter(column(op.column).isNotNull())


def fill_null(df: DataFrame, op: T.Op) -> DataFrame:
    kind, value = known(df, op.column), op.value
    if isinstance(value, str) != isinstance(kind, S.StringType) or not (isinstance(value, str) or is_number(kind)):
        raise ScriptError("type", f"fillNull of {kind.simpleString()} with {value!r}", op.line)
    to = kind
    if isinstance(value, float) and isinstance(kind, WHOLE):
        to = S.DoubleType()
    elif isinstance(value, int) and isinstance(kind, WHOLE) and not isinstance(kind, S.LongType):
        to = S.LongType()
    return df.withColumn(op.column, F.coalesce(column(op.column).cast(to), F.lit(value).cast(to)))


def with_column(df: DataFrame, op: T.Op) -> DataFrame:
    return df.withColumn(op.column, compile_expr(op.value, df.schema)[0])


def cast(df: DataFrame, op: T.Op) -> DataFrame:
    known(df, op.column)
    if op.to not in CASTS:
        raise ScriptError("type", f"cast to '{op.to}'; there are float, int, str, bool", op.line)
    return df.withColumn(op.column, column(op.column).try_cast(CASTS[op.to]))


def rename(df: DataFrame, op: T.Op) -> DataFrame:
    if op.old != op.new and op.old in df.columns and op.new in df.columns:
        raise ScriptError("name", f"rename to '{op.new}', which is there already", op.line)
    return df.toDF(*[op.new if c == op.old else c for c in df.columns])


def replace(df: DataFrame, op: T.Op) -> DataFrame:
    kind = known(df, op.column)
    if not isinstance(kind, S.StringType):
        raise ScriptError("type", f"replace in {kind.simpleString()}", op.line)
    return df.withColumn(op.column, F.replace(column(op.column), F.lit(op.old), F.lit(op.new)))


def sample(df: DataFrame, op: T.Op) -> DataFrame:
    """Exactly n rows (all, if fewer), chosen by a hash of the rows' contents and the seed, whatever the partitions.

    Without a seed one is drawn when the pipeline is built, so all readers of the result see the same rows.
    """
    return ranks.sample(df, op.n, random.getrandbits(62) if op.seed is None else op.seed)


def _ignoring_nan(agg, name: str, kind: S.DataType) -> Column:
    c = column(name)
    if isinstance(kind, REAL):
        return F.coalesce(agg(F.when(~F.isnan(c), c)), agg(c))
    return agg(c)


def aggregate(df: DataFrame, op: T.Op, key: str | None) -> DataFrame:
    """One aggregate, by ``key`` if there is one; the result keeps the column's name."""
    kind, c = known(df, op.column), column(op.column)
    if key is not None:
        known(df, key)
        if key == op.column:
            raise ScriptError("name", f"{op.name} of the group's own key '{key}'", op.line)
    if op.name in ("sum", "mean", "median", "variance", "std") and not (is_number(kind) or isinstance(kind, S.BooleanType)):
        raise ScriptError("type", f"{op.name} of {kind.simpleString()}", op.line)
    if isinstance(kind, S.BooleanType) and op.name not in ("count", "min", "max"):
        c, kind = c.cast("long"), S.LongType()
    if op.name == "sum":
        out = F.coalesce(F.sum(c), F.lit(0).cast("long" if isinstance(kind, WHOLE) else "double"))
    elif op.name in ("min", "max"):
        out = _ignoring_nan(F.min if op.name == "min" else F.max, op.column, kind)
    else:
        out = {"count": F.count, "mean": F.avg, "median": F.median, "variance": F.var_samp, "std": F.stddev_samp}[op.name](c)
    if op.name == "median" and key is None:
        return ranks.median(df.select(c.alias(op.column)))
    grouped = df.groupBy(column(key)) if key is not None else df.groupBy()
    return grouped.agg(out.alias(op.column))


AGGREGATES = ("count", "sum", "mean", "min", "max", "median", "variance", "std")
SIMPLE = {
    "filter": filter_, "select": select, "orderBy": order_by, "take": take, "dropNull": drop_null, "fillNull": fill_null,
    "withColumn": with_column, "cast": cast, "rename": rename, "replace": replace, "sample": sample,
}
#: Steps that look at one row at a time, so that they may run on a stream.
ROWWISE = ("filter", "select", "dropNull", "fillNull", "withColumn", "cast", "rename", "replace", "count", "chart")
