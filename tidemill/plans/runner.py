"""Programs to lazy DataFrames.

Statements run in order; one that fails is logged and the rest go on, and the program's result is the last
variable that was bound.  No rows are computed until a result, a sink or a check asks for them, so filters and
column choices reach the scan across variables (loading CSV files may look through them once, see ``sources.load``).  ``groupBy`` waits
for the next aggregate, which consumes it.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from ..lang import tree as T
from ..lang.errors import ScriptError, did_you_mean
from ..lang.parser import parse
from ..operators.joins import join
from ..operators.relational import AGGREGATES, SIMPLE, aggregate
from ..sources import sinks
from ..sources.load import Fields, load, null_violations

log = logging.getLogger("tidemill")


class Session:
    """Variables and types of a program, and what happened while it ran."""

    def __init__(self, spark: SparkSession, strict: bool = False, chart_folder: str | None = None, path_of: Callable[[str], str] = str, encoding: str = "auto", tables: dict[str, DataFrame] | None = None, multiline: bool | None = None, keep: bool = False):
        """``path_of`` maps the script's paths (a sandbox may refuse some); ``strict`` makes warnings errors.

        ``keep``: results with several readers that take a shuffle are kept on disk until ``close``.
        """
        self.spark, self.strict, self.chart_folder, self.path_of = spark, strict, chart_folder, path_of
        self.encoding, self.multiline, self.keep = encoding, multiline, keep
        self.variables: dict[str, DataFrame] = dict(tables or {})
        self.types: dict[str, Fields] = {}
        self.declared: dict[str, Fields] = {}
        self.models: dict[str, T.Model] = {}
        self.errors: list[str] = []
        self.messages: list[str] = []
        self.charts: list[dict] = []
        self.last: str | None = None
        self._uses: Counter = Counter()
        self._held: list[DataFrame] = []

    # Programs

    def run(self, program: str | T.Program) -> DataFrame | None:
        """The last bound variable, not computed yet; None if there is none."""
        if isinstance(program, str):
            program = parse(program)
        self._uses += Counter(name for s in program.statements for name in reads(s))
        for s in program.statements:  # types may be declared after their use
            if isinstance(s, T.TypeDecl):
                self.types[s.name] = s.fields
        for s in program.statements:
            try:
                self.statement(s)
            except (ScriptError, PySparkException) as e:
                text = str(e).split("\n")[0] if isinstance(e, PySparkException) else str(e)
                self.errors.append(f"{getattr(s, 'name', 'statement')}: {text}")
                log.error("%s", self.errors[-1])
        return self.variables.get(self.last) if self.last else None

    def statement(self, s) -> None:
        if isinstance(s, T.Assign):
            self.variables[s.name] = self.pipeline(s.source, s.ops, s.name)
            self.last = s.name
            if isinstance(s.source, T.Load) and not any(op.name in ("rename", "select") for op in s.ops):
                self.declared[s.name] = self.types.get(s.source.schema, ())
            else:
                self.declared.pop(s.name, None)
            if self.strict:
                bad = self.violations(s.name)
                if bad:
                    del self.variables[s.name]
                    self.last = None
                    raise ScriptError("data", f"nulls in columns declared without Option: {bad}")
        elif isinstance(s, T.Perform):
            if any(op.name == "chart" for op in s.ops):  # without a sink there is nothing to see
                self.pipeline(s.source, s.ops, s.source.name)
        elif isinstance(s, T.Model):
            self.models[s.name] = s
            layers = [f"{k}({'' if a is None else a})" for k, a in s.layers]
            self.messages.append(sinks.marker("model", {"type": "model_decl", "name": s.name, "layers": layers}))
        elif isinstance(s, T.Train):
            if s.source not in self.variables:
                log.warning("training data '%s' is not a variable", s.source)
            config = {"target": s.target, "epochs": s.epochs, "learning_rate": s.lr, "batch_size": s.batch_size, "validation_split": s.validation_split}
            self.messages.append(sinks.marker("train", {"type": "train_stmt", "source_var": s.source, "model_name": s.model, "config": config}))

    def violations(self, name: str) -> dict[str, int]:
        """Nulls against the declared type of a loaded variable; runs one aggregate."""
        return null_violations(self.variables[name], self.declared.get(name, ()))

    # Pipelines

    def variable(self, name: str) -> DataFrame:
        if name not in self.variables:
            raise ScriptError("name", f"no variable '{name}'", hint=did_you_mean(name, self.variables))
        return self.variables[name]

    def source(self, s: T.Load | T.Ref) -> DataFrame:
        if isinstance(s, T.Ref):
            return self.variable(s.name)
        return load(self.spark, self.path_of(s.path), self.types.get(s.schema), self.encoding, self.multiline)

    def pipeline(self, source: T.Load | T.Ref, ops: tuple[T.Op, ...], name: str) -> DataFrame:
        df, key = self.source(source), None
        for op in ops:
            if op.name == "groupBy":
                key = op.key
            elif op.name in AGGREGATES and (op.name != "count" or op.column is not None):
                df, key = aggregate(df, op, key), None
            elif op.name == "join":
                df = join(df, self.variable(op.other), op)
            elif op.name == "chart":
                spec = sinks.chart_spec(df, op.args)
                self.charts.append(spec)
                self.messages.append(sinks.marker("chart", spec))
                if self.chart_folder:
                    sinks.write_chart(name, spec, self.chart_folder)
            elif op.name == "sample":
                if self.strict and df.limit(op.n).count() < op.n:
                    raise ScriptError("data", f"sample of {op.n} from fewer rows", op.line)
                df = SIMPLE["sample"](df, op)
            elif op.name != "count":  # a count without a column leaves rows as they are
                df = SIMPLE[op.name](df, op)
        if self.keep and self._uses[name] > 1 and any(op.name in (*AGGREGATES, "join", "sample") for op in ops):
            # Several readers of a result that takes a shuffle; plain scans are cheaper to read again, pruned.
            df = df.persist(StorageLevel.DISK_ONLY)
            self._held.append(df)
        return df

    def close(self) -> None:
        """Give back what was kept for several readers."""
        while self._held:
            self._held.pop().unpersist()


def reads(s) -> list[str]:
    """Variables that a statement reads."""
    if not isinstance(s, (T.Assign, T.Perform)):
        return []
    first = [s.source.name] if isinstance(s.source, T.Ref) else []
    return first + [op.other for op in s.ops if op.name == "join"]


def run(spark: SparkSession, text: str, **options) -> DataFrame:
    """The result of a script, which holds nothing on the cluster; its first error if nothing was bound."""
    session = Session(spark, **options)
    out = session.run(text)
    if out is None:
        raise ScriptError("data", session.errors[0] if session.errors else "the program binds no variable")
    return out
