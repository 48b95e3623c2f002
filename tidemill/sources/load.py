"""``load(path) :: Type``: CSV, Parquet or JSON to a DataFrame of the declared type.

CSV cells are read as text, so that nothing depends on a guess: cells that mean "missing" become
null, columns are matched to the declared fields by position, and cells are cast tolerantly (bad ones become null).
Columns without a declaration get the narrowest type that every one of their cells has, found by one distributed aggregate.

Records follow the usual CSV rules: a quoted cell may hold separators, doubled quotes and line breaks.  Unless ``encoding`` and
``multiline`` say how the files are, one distributed pass over the bytes finds two kinds of files that need care:

* files that are not valid UTF-8 are read as Korean (code page 949), whole files by Python tasks (of 2 GB each at most);
* files with a line break inside quotes (some line has an odd number of quotes) are read by one task each, others in splits.

Reading never changes the session's settings.
"""

from __future__ import annotations

import csv
import io
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import column
from ..lang.errors import ScriptError
from ..session import ship

# Cells that are read as null.
MISSING = ("", " ", "-", "점검중", "N/A")
TYPES = {"string": "string", "str": "string", "int": "bigint", "float": "double", "bool": "boolean"}
FOREIGN = "cp949"
Fields = tuple[tuple[str, str], ...]


def split_option(kind: str) -> tuple[str, bool]:
    """The inner type, and whether null is allowed."""
    m = re.fullmatch(r"Option<(\w+)>", kind)
    return (m[1], True) if m else (kind, False)


def _odd_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files below ``path`` that are not valid UTF-8, and valid ones with a line break inside quotes; of their names, only these come to the driver."""
    line = F.col("value")
    foreign = ~F.call_function("is_valid_utf8", line)
    quotes = F.length(line.cast("binary")) - F.length(F.replace(line, F.lit('"'), F.lit("")).cast("binary"))
    broken = ~foreign & line.contains('"') & (quotes % 2 == 1)
    lines, marks = spark.read.text(path), [F.max(foreign).alias("foreign"), F.max(broken).alias("broken")]
    if not any(lines.agg(*marks).first()):  # the usual case needs no names
        return [], []
    rows = lines.groupBy(F.col("_metadata.file_path").alias("f")).agg(*marks).filter("foreign or broken").collect()
    return sorted(_one_form(r["f"]) for r in rows if r["foreign"]), sorted(_one_form(r["f"]) for r in rows if not r["foreign"])


def _one_form(path: str) -> str:
    """A file's URI as a path that Spark reads: plain characters, and three slashes at the root of local paths."""
    return unquote(re.sub("^file:/+", "file:///", path))


def _files(spark: SparkSession, path: str) -> list[str]:
    """All data files below ``path``, as Spark lists them."""
    return [_one_form(f) for f in spark.read.text(path).inputFiles()]


def _decoded(batches, header, encoding):
    """Records of whole files in another encoding, as many cells as the header has; empty cells are null."""
    for batch in batches:
        for content in batch.column("content"):
            records = csv.reader(io.StringIO(content.as_py().decode(encoding, "replace"), newline=""))
            next(records, None)
            columns: list[list] = [[] for _ in header]

            def full(columns=columns):
                return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[f"c{k}" for k in range(len(header))])

            for r in records:
                if r:
                    for k, c in enumerate(columns):
                        c.append(r[k] if k < len(r) and r[k] != "" else None)
                    if len(columns[0]) >= 10_000:
                        yield full()
                        for c in columns:
                            c.clear()
            if columns and columns[0]:
                yield full()


def _read_foreign(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("content")
    head = spark.read.text(paths[0]).select(F.col("value").cast("binary").alias("line")).first()
    header = next(csv.reader([bytes(head["line"]).decode(encoding, "replace")]), []) if head else []
    if not header:
        return spark.createDataFrame([], "value string").select()
    out = files.mapInArrow(lambda it: _decoded(it, header, encoding), ", ".join(f"c{k} string" for k in range(len(header))))
    return out.toDF(*header)


def read_csv(spark: SparkSession, path: str, encoding: str = "auto", multiline: bool | None = None) -> DataFrame:
    """All columns as text.  ``encoding``: ``auto``, ``utf-8`` or any that Python knows; ``multiline``: None to find out."""

    def raw(paths, whole):
        reader = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", bool(whole))
        return reader.csv(paths)

    plain = encoding.upper() in ("UTF-8", "UTF8")
    if plain and multiline is not None:
        df = raw(path, multiline)
    elif encoding != "auto" and not plain:
        df = _read_foreign(spark, sorted(_files(spark, path)), encoding)
    else:
        foreign, broken = _odd_files(spark, path)
        foreign, broken = ([] if plain else foreign), ([] if multiline is False else broken)
        if not foreign and not broken:
            df = raw(path, multiline)
        else:
            rest = sorted(set(_files(spark, path)) - {*foreign, *broken})
            parts = [raw(x, w) for x, w in ((rest, multiline), (broken, True)) if x] + ([_read_foreign(spark, foreign, FOREIGN)] if foreign else [])
            if len({len(x.columns) for x in parts}) > 1:
                raise ScriptError("data", f"the files of '{path}' have different numbers of columns")
            df = parts[0]
            for x in parts[1:]:
                df = df.union(x)
    names = [c.lstrip("\ufeff") for c in df.columns]
    return df.toDF(*names).select(*[F.when(~column(c).isin(*MISSING), column(c)).alias(c) for c in names])


def inferred(df: DataFrame) -> dict[str, str]:
    """Spark types for text columns: the narrowest that all cells have, by one aggregate over them; text without cells."""
    tests = {
        "boolean": r"^\s*(?i:true|false)\s*$",
        "bigint": r"^\s*[+-]?\d+\s*$",
        "double": r"^\s*[+-]?(?i:\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$",
    }
    wants = []
    for k, name in enumerate(df.columns):
        c = column(name)
        for kind, pattern in tests.items():
            fits = c.rlike(pattern)
            if kind == "bigint":  # not beyond 64 bits
                fits = fits & F.trim(c).try_cast("bigint").isNotNull()
            wants.append(F.min(F.when(c.isNotNull(), fits)).alias(f"{kind}{k}"))
    row = df.agg(*wants).first()
    return {name: next((kind for kind in tests if row[f"{kind}{k}"]), "string") for k, name in enumerate(df.columns)}


def conform(df: DataFrame, fields: Fields | None, by_name: bool, guess: bool) -> DataFrame:
    """Declared names and types; surplus columns stay."""
    fields = fields or ()
    names = [n for n, _ in fields]
    if fields and not (by_name and set(names) <= set(df.columns)):
        if len(names) > len(df.columns):
            raise ScriptError("data", f"the type declares '{names[len(df.columns)]}', but there are only {len(df.columns)} columns")
        df = df.toDF(*names, *df.columns[len(names) :])
    if len(set(df.columns)) < len(df.columns):
        raise ScriptError("data", "a declared name is also the name of a surplus column")
    declared = {n: TYPES.get(split_option(t)[0]) for n, t in fields}
    surplus = [c for c in df.columns if c not in declared]
    found = inferred(df.select(*[column(c) for c in surplus])) if guess and surplus else {}
    out = []
    for c in df.columns:
        to = declared.get(c) or found.get(c)
        out.append(column(c).try_cast(to).alias(c) if to and df.schema[c].dataType.simpleString() != to else column(c))
    return df.select(*out)


def load(spark: SparkSession, path: str, fields: Fields | None, encoding: str = "auto", multiline: bool | None = None) -> DataFrame:
    kind = re.sub(r".*\.", "", path.rstrip("/").lower())
    if kind == "parquet":
        return conform(spark.read.parquet(path), fields, True, False)
    if kind in ("json", "jsonl", "ndjson"):
        return conform(spark.read.json(path), fields, True, False)
    return conform(read_csv(spark, path, encoding, multiline), fields, False, True)


def null_violations(df: DataFrame, fields: Fields) -> dict[str, int]:
    """Nulls in columns that are declared without Option; one aggregate."""
    strict = [n for n, t in fields if not split_option(t)[1] and n in df.columns]
    if not strict:
        return {}
    row = df.agg(*[F.coalesce(F.sum(column(n).isNull().cast("long")), F.lit(0)).alias(f"c{k}") for k, n in enumerate(strict)]).first()
    return {n: row[k] for k, n in enumerate(strict) if row[k]}
