"""Rows by their rank among all rows, without a task that holds them all: histograms narrow the ranks down first.

Both functions run no job; their histograms are parts of the result's plan, and at most ``BUCKETS`` rows of one meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import column

BUCKETS = 1 << 16
#: Samples up to this many rows are a top-k of each partition, merged.
TOP_ROWS = 10_000
_LAST = 2**63 - 1


def _spread(v: Column) -> Column:
    """A bucket that never falls while ``v`` grows: logarithmic, so that far outliers leave the others apart; NaN comes last."""
    return F.when(F.isnan(v), _LAST).otherwise((F.signum(v) * F.least(F.log1p(F.abs(v)), F.lit(1000.0)) * (BUCKETS // 2048)).cast("long"))


def _within(v: Column) -> Column:
    part = F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo"))
    return F.when(part.isNull() | F.isnan(part), F.lit(0).cast("long")).otherwise((part * BUCKETS).cast("long"))


def _holds(rank: str) -> Column:
    return (F.col("skip") < F.col(rank)) & (F.col("skip") + F.col("n") >= F.col(rank))


def median(df: DataFrame) -> DataFrame:
    """The exact median of the only column: of an even number of values the mean of the middle two; null without values.

    Values are counted; of the buckets by magnitude, which span a factor of 1.03 (those next to zero 0.03), the ones that hold the middle
    ranks are divided by ``BUCKETS`` again.  What is left for one task are the distinct values of a bucket's bucket.  The input is read more
    than once unless Spark reuses the shuffle of its values.
    """
    (name,) = df.columns
    v = F.col("v").cast("double")
    left = df.select(column(name).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    bucket, order = _spread(v), Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = left.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    total = F.sum("n").over(Window.partitionBy())
    ends = counts.select("*", F.ceil(total / 2).alias("low"), F.floor(total / 2 + 1).alias("high"), (F.sum("n").over(order) - F.col("n")).alias("skip"))
    # The buckets that hold a middle rank: two at most, told apart by the values before them.
    chosen = ends.filter(_holds("low") | _holds("high")).select("bucket", "skip", "lo", "hi", "low", "high")
    left = left.withColumn("bucket", bucket).join(F.broadcast(chosen), "bucket").select("v", "n", F.col("skip").alias("segment"), _within(v).alias("bucket"), "low", "high")
    order = Window.partitionBy("segment").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = left.groupBy("segment", "bucket", "low", "high").agg(F.sum("n").alias("n"))
    ends = counts.withColumn("skip", F.col("segment") + F.sum("n").over(order) - F.col("n"))
    chosen = ends.filter(_holds("low") | _holds("high")).select("segment", "bucket", "skip")
    left = left.join(F.broadcast(chosen), ["segment", "bucket"])
    order = Window.partitionBy("skip").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = left.withColumn("skip", F.col("skip") + F.sum("n").over(order) - F.col("n"))
    low, high = (F.max(F.when(_holds(k), v)) for k in ("low", "high"))
    return ends.agg((low * 0.5 + high * 0.5).alias(name))


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows with the smallest hashes.

    Beyond ``TOP_ROWS`` rows a histogram of the hashes finds the bucket of the n-th: rows below are taken where they are, and
    equal rows of that bucket are counted, not gathered.
    """
    cols = [column(c) for c in df.columns]
    keys = [F.xxhash64(*cols, F.lit(seed)), F.xxhash64(F.lit(seed), *cols)]
    if n <= TOP_ROWS:
        return df.orderBy(*keys).limit(n)
    rows = df.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).alias("row"), keys[0].alias("h1"), keys[1].alias("h2")).withColumn("bucket", F.shiftright("h1", 48))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counts.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("room", F.lit(n) - F.col("before")).filter("room > 0").select("bucket", "n", "room")
    taken = rows.join(F.broadcast(ends), "bucket")
    whole = taken.filter("n <= room").select("row")
    kinds = taken.filter("n > room").groupBy("h1", "h2", "room").agg(F.first("row").alias("row"), F.count("*").alias("copies"))
    order = Window.orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = kinds.withColumn("room", F.col("room") - F.sum("copies").over(order) + F.col("copies")).filter("room > 0")
    edge = kinds.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("room", "copies")))).select("row")
    return whole.unionByName(edge).select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)])
