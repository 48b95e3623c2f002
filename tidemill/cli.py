"""Command line: run, check, emit, plan, new, import, hash, bench, serve."""

from __future__ import annotations

import argparse
import os
import sys

from . import project
from .lang.errors import ScriptError


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemill", description=__doc__)
    sub = p.add_subparsers(dest="do", required=True)
    run = sub.add_parser("run", help="run a script")
    run.add_argument("file")
    run.add_argument("--output", help="write the whole result as CSV into this folder")
    run.add_argument("--charts", help="write chart pages into this folder")
    run.add_argument("--strict", action="store_true", help="nulls against the declared types are errors")
    run.add_argument("--encoding", default="auto", help="of CSV files; found out unless it is given")
    run.add_argument("--multiline", action=argparse.BooleanOptionalAction, help="whether quoted cells of CSV files hold line breaks; found out unless it is said")
    run.add_argument("--verbose", action="store_true", help="show the plan first")
    for name, text in (("check", "check columns and types"), ("plan", "show the steps"), ("hash", "print the script's SHA-256")):
        sub.add_parser(name, help=text).add_argument("file")
    emit = sub.add_parser("emit", help="translate a script")
    emit.add_argument("format", choices=["pyspark"])
    emit.add_argument("file")
    emit.add_argument("--output")
    sub.add_parser("new", help="start a project").add_argument("folder")
    sub.add_parser("import", help="add a CSV file's type to the project").add_argument("file")
    sub.add_parser("bench", help="time the air-quality workload on a CSV file").add_argument("file")
    serve = sub.add_parser("serve", help="HTTP service")
    serve.add_argument("--port", type=int, default=8080)
    serve.add_argument("--root", default=".", help="scripts may load files below this folder only")
    a = p.parse_args(argv)
    try:
        return _do(a)
    except ScriptError as e:
        print(e, file=sys.stderr)
        return 1
    except OSError as e:
        print(e, file=sys.stderr)
        return 1


def _do(a) -> int:
    from .plans import translate

    if a.do == "new":
        print(project.new(a.folder))
    elif a.do == "import":
        print(project.import_csv(a.file) or "the type is there already")
    elif a.do == "hash":
        print(project.fingerprint(_read(a.file)))
    elif a.do == "plan":
        print(translate.describe(_read(a.file)), end="")
    elif a.do == "emit":
        text = translate.emit_pyspark(_read(a.file))
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text, end="")
    elif a.do == "serve":
        from .server import serve

        serve(_spark(), a.port, a.root)
    elif a.do == "bench":
        from .plans.workload import run_csv

        for name, seconds in run_csv(_spark(), os.path.abspath(a.file) if os.path.exists(a.file) else a.file).items():
            print(f"{name}: {seconds:.3f} s")
    elif a.do == "check":
        from .plans.check import check

        found = check(_spark(), _read(a.file))
        for f in found:
            print(f"{f.level}: {f.where}: {f.message}")
        return int(any(f.level == "error" for f in found))
    else:
        from .plans.runner import Session
        from .sources import sinks

        text = _read(a.file)
        if a.verbose:
            print(translate.describe(text), end="")
        # Files that are there are meant; other paths are left to Spark's default file system.
        session = Session(_spark(), strict=a.strict, chart_folder=a.charts, encoding=a.encoding, multiline=a.multiline, keep=True, path_of=lambda p: os.path.abspath(p) if os.path.exists(p) else p)
        df = session.run(text)
        for line in session.messages:
            print(line)
        for line in session.errors:
            print(line, file=sys.stderr)
        if df is not None:
            df.show(sinks.SHOWN_ROWS)
            print(sinks.marker("result", sinks.result(df)))
            if a.output:
                sinks.write_csv(df, a.output, single=True)
        session.close()
    return 0
