"""The published benchmark's workload on an air-quality CSV: date, station, pm10, pm25."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from .runner import Session

SCRIPT = """
type AirQuality = { date: string, station: string, pm10: Option<float>, pm25: Option<float>, }
v raw = load("{path}") :: AirQuality |> select([date, station, pm10, pm25])
v cleaned = raw |> dropNull("pm10") |> filter(pm10 < 120) |> filter(pm25 > 10)
v by_station = cleaned |> groupBy("station") |> sum("pm10")
v top10_mean = cleaned |> groupBy("station") |> mean("pm10") |> orderBy("pm10", desc: true) |> take(10)
v filled = raw |> fillNull("pm25", 0) |> filter(pm10 > 50) |> groupBy("station") |> count("pm25") |> orderBy("pm25", desc: true) |> take(5)
"""
OUTPUTS = ("cleaned", "by_station", "top10_mean", "filled")


def compute(df: DataFrame) -> None:
    """Run a plan to its end without keeping rows."""
    df.write.format("noop").mode("overwrite").save()


def run_csv(spark: SparkSession, path: str) -> dict[str, float]:
    """Seconds for each output of the workload, and in all."""
    began = time.time()
    session = Session(spark, keep=True)
    session.run(SCRIPT.replace("{path}", path))
    if session.errors:
        raise RuntimeError(session.errors[0])
    out = {"plan": time.time() - began}
    for name in OUTPUTS:
        t = time.time()
        compute(session.variables[name])
        out[name] = time.time() - t
    session.close()
    return out | {"total": time.time() - began}


def make_csv(spark: SparkSession, path: str, rows: int) -> None:
    """Deterministic air-quality rows as CSV files, some cells missing."""
    spark.range(rows).selectExpr(
        "concat('2026-', lpad(1 + id % 12, 2, '0'), '-', lpad(1 + id % 28, 2, '0')) as date",
        "concat('station', pmod(xxhash64(id), 40)) as station",
        "if(pmod(xxhash64(id, 1), 50) = 0, '-', cast(round(pmod(xxhash64(id, 2), 1500) / 10.0, 1) as string)) as pm10",
        "if(pmod(xxhash64(id, 3), 40) = 0, null, cast(round(pmod(xxhash64(id, 4), 800) / 10.0, 1) as string)) as pm25",
    ).write.mode("overwrite").option("header", True).csv(path)
