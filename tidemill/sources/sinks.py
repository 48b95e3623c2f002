"""Results out of the engine: JSON marker, CSV, chart specification and page."""

from __future__ import annotations

import datetime
import html
import json
import math
import os
import re
from decimal import Decimal

from pyspark.sql import DataFrame

from ..functions.expressions import column
from ..lang.errors import ScriptError, unknown_column

RESULT_ROWS, SHOWN_ROWS = 500, 5
#: A chart holds every row; tables with more rows than this are refused, not cut.
CHART_ROWS = 100_000
NAMES = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "string": "str", "boolean": "bool"}


def cell(value):
    """A value as strict JSON has it."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else value.isoformat()
    return str(value) if isinstance(value, Decimal) or not isinstance(value, (list, tuple)) else [cell(x) for x in value]


def rows_json(df: DataFrame, limit: int) -> list[dict]:
    return [{k: cell(v) for k, v in sorted(zip(df.columns, r, strict=True))} for r in df.limit(limit).collect()]


def result(df: DataFrame) -> dict:
    """At most ``RESULT_ROWS`` rows and the schema."""
    schema = [{"name": f.name, "type": NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())} for f in df.schema]
    return {"rows": rows_json(df, RESULT_ROWS), "schema": schema}


def marker(kind: str, value: dict) -> str:
    return f"[tidemill:{kind}] " + json.dumps(value, ensure_ascii=False, allow_nan=False)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of CSV files with headers; ``single``: one file in it, for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def chart_spec(df: DataFrame, args: dict) -> dict:
    for k in ("x", "y", "label", "value"):
        if k in args and args[k] not in df.columns:
            err = unknown_column(args[k], df.columns)
            err.message = f"VIZ001: {err.message}"
            raise err
    own = {k: args[k] for k in ("x", "y", "label", "value") if k in args}
    data = rows_json(df.select(*[column(c) for c in df.columns]), CHART_ROWS + 1)
    if len(data) > CHART_ROWS:
        raise ScriptError("data", f"VIZ004: a chart of more than {CHART_ROWS} rows", hint="aggregate or take rows first")
    return {"chartType": args["kind"], "title": args.get("title", ""), **own, "data": data}


def chart_page(spec: dict) -> str:
    """A page that draws the chart with inline SVG; every value is escaped, nothing is fetched."""
    data = json.dumps(spec, ensure_ascii=False, allow_nan=False).replace("<", "\\u003c").replace("&", "\\u0026")
    title = html.escape(spec["title"] or spec["chartType"])
    return f"""<!doctype html>
<html><head><meta charset="utf-8"><title>{title}</title></head>
<body><h1>{title}</h1><svg id="c" width="900" height="480" font-size="11"></svg>
<script type="application/json" id="spec">{data}</script>
<script>
const s = JSON.parse(document.getElementById("spec").textContent), c = document.getElementById("c");
const kx = s.x || s.label, ky = s.y || s.value, ys = s.data.map(r => Number(r[ky]) || 0), n = ys.length;
const add = (t, a, txt) => {{ const e = document.createElementNS("http://www.w3.org/2000/svg", t); for (const k in a) e.setAttribute(k, a[k]); if (txt !== undefined) e.textContent = txt; c.appendChild(e); }};
if (s.chartType === "pie") {{
  const sum = ys.reduce((a, b) => a + b, 0) || 1; let a = 0;
  ys.forEach((v, i) => {{ const b = a + v / sum * 2 * Math.PI, p = t => (450 + 200 * Math.sin(t)) + " " + (240 - 200 * Math.cos(t));
    add("path", {{d: "M450 240L" + p(a) + "A200 200 0 " + (b - a > Math.PI ? 1 : 0) + " 1 " + p(b) + "Z", fill: "hsl(" + i * 47 % 360 + ",60%,60%)"}});
    add("text", {{x: 10, y: 20 + 14 * i}}, s.data[i][kx] + ": " + v); a = b; }});
}} else {{
  const xs = s.chartType === "scatter" ? s.data.map(r => Number(r[kx]) || 0) : ys.map((_, i) => i);
  const lo = Math.min(0, ...ys), hi = Math.max(...ys, lo + 1e-9), xl = Math.min(...xs), xh = Math.max(...xs, xl + 1e-9);
  const X = v => 60 + 800 * (v - xl) / (xh - xl), Y = v => 440 - 400 * (v - lo) / (hi - lo);
  if (s.chartType === "line") add("polyline", {{points: ys.map((v, i) => X(xs[i]) + "," + Y(v)).join(" "), fill: "none", stroke: "steelblue"}});
  ys.forEach((v, i) => {{
    if (s.chartType === "bar") add("rect", {{x: 60 + 800 * i / n, y: Math.min(Y(v), Y(0)), width: 760 / n, height: Math.abs(Y(v) - Y(0)), fill: "steelblue"}});
    else add("circle", {{cx: X(xs[i]), cy: Y(v), r: 3, fill: "steelblue"}});
    if (n <= 40) add("text", {{x: s.chartType === "bar" ? 60 + 800 * i / n : X(xs[i]), y: 458}}, s.data[i][kx]); }});
  add("text", {{x: 4, y: 40}}, hi); add("text", {{x: 4, y: 440}}, lo);
}}
</script></body></html>
"""


def write_chart(variable: str, spec: dict, folder: str) -> str:
    name = re.sub(r"[^\w-]", "_", variable) or "chart"
    path = os.path.join(folder, f"{name}_chart.html")
    with open(path, "w", encoding="utf-8") as f:
        f.write(chart_page(spec))
    return path
