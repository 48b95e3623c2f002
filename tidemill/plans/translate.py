"""Programs as text: a readable plan, and a PySpark script that computes the same."""

from __future__ import annotations

from ..lang import tree as T
from ..lang.parser import parse
from ..operators.relational import AGGREGATES


def expr_text(e) -> str:
    if isinstance(e, T.Col):
        return e.name
    if isinstance(e, T.Lit):
        return f'"{e.value}"' if isinstance(e.value, str) else str(e.value).lower() if isinstance(e.value, bool) else str(e.value)
    return f"({expr_text(e.left)} {e.op} {expr_text(e.right)})"


def _arg(v) -> str:
    if isinstance(v, (T.Col, T.Lit, T.Binary)):
        return expr_text(v)
    if isinstance(v, tuple):
        return "[" + ", ".join(v) + "]"
    return repr(v)


def describe(text: str) -> str:
    """One line per statement, one indented line per step."""
    out = []
    for s in parse(text).statements:
        if isinstance(s, T.TypeDecl):
            out.append(f"schema {s.name}({', '.join(f'{n} {t}' for n, t in s.fields)})")
        elif isinstance(s, (T.Assign, T.Perform)):
            src = f"scan {s.source.path!r} as {s.source.schema}" if isinstance(s.source, T.Load) else f"read {s.source.name}"
            out.append(f"{s.name if isinstance(s, T.Assign) else 'perform'} <- {src}")
            out += [f"  {op.name} " + ", ".join(f"{k}={_arg(v)}" for k, v in op.args.items()) for op in s.ops]
        elif isinstance(s, T.Model):
            out.append(f"model {s.name}: " + " -> ".join(f"{k}({'' if a is None else a})" for k, a in s.layers))
        else:
            out.append(f"train {s.model} on {s.source}, target={s.target!r}, epochs={s.epochs}, lr={s.lr}")
    return "\n".join(line.rstrip() for line in out) + "\n"


def _tree(e) -> str:
    if isinstance(e, T.Col):
        return f"T.Col({e.name!r})"
    if isinstance(e, T.Lit):
        return f"T.Lit({e.value!r})"
    if isinstance(e, T.Binary):
        return f"T.Binary({e.op!r}, {_tree(e.left)}, {_tree(e.right)})"
    return repr(e)


def emit_pyspark(text: str) -> str:
    """A script that builds each variable by this package's steps and shows the last one."""
    program = parse(text)
    types = {s.name: s.fields for s in program.statements if isinstance(s, T.TypeDecl)}
    out = [
        "from pyspark.sql import SparkSession",
        "",
        "from tidemill.lang import tree as T",
        "from tidemill.operators.joins import join",
        "from tidemill.operators.relational import SIMPLE, aggregate",
        "from tidemill.sources.load import load",
        "",
        "spark = SparkSession.builder.getOrCreate()",
    ]
    last = None
    for s in program.statements:
        if not isinstance(s, T.Assign):
            continue
        src = f"load(spark, {s.source.path!r}, {types.get(s.source.schema)!r})" if isinstance(s.source, T.Load) else s.source.name
        out += ["", f"{s.name} = {src}"]
        key = None
        for op in s.ops:
            args = "{" + ", ".join(f"{k!r}: {_tree(v)}" for k, v in op.args.items()) + "}"
            if op.name == "groupBy":
                key = op.key
            elif op.name in AGGREGATES and op.column is not None:
                out.append(f"{s.name} = aggregate({s.name}, T.Op({op.name!r}, {args}), {key!r})")
                key = None
            elif op.name == "join":
                out.append(f"{s.name} = join({s.name}, {op.other}, T.Op('join', {args}))")
            elif op.name in ("count", "chart"):
                out.append(f"# {op.name}: leaves the rows as they are")
            else:
                out.append(f"{s.name} = SIMPLE[{op.name!r}]({s.name}, T.Op({op.name!r}, {args}))")
        last = s.name
    if last:
        out += ["", f"{last}.show(5)"]
    return "\n".join(out) + "\n"
