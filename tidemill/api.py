"""The fluent form of the language: the same tree, built by method calls.

>>> top = table("orders", "sf/orders.parquet").filter("o_totalprice > 1000").group_by("o_custkey").sum("o_totalprice")
>>> top.order_by("o_totalprice", desc=True).take(10).dataframe(spark)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lang import tree as T
from .lang.parser import parse_expression
from .plans.runner import Session


class Pipeline:
    def __init__(self, source: T.Load | T.Ref, ops: tuple[T.Op, ...] = (), types=None, others=None):
        self.source, self.ops, self.types, self.others = source, ops, dict(types or {}), dict(others or {})

    def _with(self, name: str, **args) -> Pipeline:
        given = {k: v for k, v in args.items() if v is not None}
        return Pipeline(self.source, (*self.ops, T.Op(name, given)), self.types, self.others)

    def filter(self, where) -> Pipeline:
        return self._with("filter", where=parse_expression(where) if isinstance(where, str) else where)

    def select(self, *columns: str) -> Pipeline:
        return self._with("select", columns=columns)

    def with_column(self, name: str, value) -> Pipeline:
        return self._with("withColumn", column=name, value=parse_expression(value) if isinstance(value, str) else value)

    def group_by(self, key: str) -> Pipeline:
        return self._with("groupBy", key=key)

    def order_by(self, column: str, desc: bool = False) -> Pipeline:
        return self._with("orderBy", column=column, desc=desc)

    def take(self, n: int) -> Pipeline:
        return self._with("take", n=n)

    def drop_null(self, column: str) -> Pipeline:
        return self._with("dropNull", column=column)

    def fill_null(self, column: str, value) -> Pipeline:
        return self._with("fillNull", column=column, value=value)

    def cast(self, column: str, to: str) -> Pipeline:
        return self._with("cast", column=column, to=to)

    def rename(self, old: str, new: str) -> Pipeline:
        return self._with("rename", old=old, new=new)

    def replace(self, column: str, old: str, new: str) -> Pipeline:
        return self._with("replace", column=column, old=old, new=new)

    def sample(self, n: int, seed: int | None = None) -> Pipeline:
        return self._with("sample", n=n, seed=seed)

    def count(self, column: str | None = None) -> Pipeline:
        return self._with("count", column=column)

    def chart(self, kind: str, **fields: str) -> Pipeline:
        return self._with("chart", kind=kind, **fields)

    def join(self, other: Pipeline, on=None, left_on=None, right_on=None, how: str = "inner") -> Pipeline:
        def keys(k):
            return (k,) if isinstance(k, str) else tuple(k) if k is not None else None

        name = f"other{len(self.others)}"
        out = self._with("join", other=name, on=keys(on), left_on=keys(left_on), right_on=keys(right_on), how=how)
        out.others[name] = other
        return out

    def dataframe(self, spark: SparkSession, **options) -> DataFrame:
        """The lazy DataFrame of the pipeline."""
        session = Session(spark, **options)
        session.types.update(self.types)
        for name, other in self.others.items():
            session.variables[name] = other.dataframe(spark, **options)
        return session.pipeline(self.source, self.ops, "pipeline")


def _aggregate(name: str):
    def method(self: Pipeline, column: str) -> Pipeline:
        return self._with(name, column=column)

    method.__name__ = name
    return method


for _name in ("sum", "mean", "min", "max", "median", "variance", "std"):
    setattr(Pipeline, _name, _aggregate(_name))


def table(name: str, path: str, fields: dict[str, str] | None = None) -> Pipeline:
    """A pipeline that begins with a file; ``fields``: declared types by name, in the file's order."""
    types = {name: tuple(fields.items())} if fields else {}
    return Pipeline(T.Load(path, name), types=types)
