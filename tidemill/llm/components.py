"""Connected components of a distributed edge list (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(moved)


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """Each node of ``edges`` (u, v: long) with the smallest node it reaches: (id, comp).

    Loops, nulls, repeated and reversed edges are allowed; without edges the
    result is empty.  Every round is written to the shared folder; minima are
    combined before shuffles, so a hub with many neighbours is one row per task.
    """
    now = scratch.put(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{name}-0",
    )
    seen = None
    for k in range(1, rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        after = scratch.put(_small(_large(now).distinct()).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("comp")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    )
