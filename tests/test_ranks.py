"""Global medians and samples by histograms against the built-in aggregate and a plain top-k."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import ranks

_r = random.Random(1)
INF, NAN = float("inf"), float("nan")
VALUES = {
    "empty": [], "nulls": [None, None], "one": [3.5], "two": [1.0, None, 4.0], "hot": [7.0] * 500 + [1.0, 2.0], "zeros": [0.0, -0.0, 0.0],
    "wide": [-1e300, 1e300, 1.0, 2.0, 3.0, 1e-300], "infinite": [INF] * 3 + [1.0, -INF], "nan": [NAN] * 3 + [1.0], "gap": [1.0] * 5 + [1e300] * 5,
    "tiny": [_r.random() * 1e-20 for _ in range(1000)], "many": [_r.gauss(0, 1e5) for _ in range(3001)],
}


@pytest.mark.parametrize("name", VALUES)
def test_median(spark, name):
    df = spark.createDataFrame([(x,) for x in VALUES[name]], "`a b` double")
    assert repr(ranks.median(df).collect()) == repr(df.agg(F.median("`a b`").alias("a b")).collect())


def test_median_of_long_integers(spark):
    df = spark.createDataFrame([(_r.randrange(-(2**62), 2**62),) for _ in range(1000)], "x long")
    assert ranks.median(df).collect() == df.agg(F.median("x").alias("x")).collect()


@pytest.mark.parametrize("n", [1, 50, 9999, 20000, 29999, 30000, 40000])
def test_sample_by_histogram(spark, monkeypatch, n):
    ids = spark.range(30000)
    hot = F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 700)  # two thirds of the rows are equal
    for df in (ids.select((F.col("id") % 9000).alias("a"), (F.col("id") % 5).alias("a b")), ids.select(hot.alias("a"))):
        monkeypatch.setattr(ranks, "TOP_ROWS", 10**9)
        plain = df.transform(ranks.sample, n, 3).groupBy(*[f"`{c}`" for c in df.columns]).count().collect()
        monkeypatch.setattr(ranks, "TOP_ROWS", 0)
        assert sorted(plain) == sorted(df.transform(ranks.sample, n, 3).groupBy(*[f"`{c}`" for c in df.columns]).count().collect())
