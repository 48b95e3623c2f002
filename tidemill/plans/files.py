"""Queries over CSV files: the benchmark tables written by the CSV sink into the shared folder, read back by scripts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import sinks
from .runner import Session, run

CUSTOMER = "type Customer = { c_custkey: int, c_name: string, c_nationkey: int, c_acctbal: float, c_mktsegment: string }\n"
_CUSTOMER_SQL = "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer"


@dataclass(frozen=True)
class FileQuery:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame) -> str:
    """A new folder of CSV files with the table."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(df, path)
    return path


def written_as(spark: SparkSession, text: str, encoding: str) -> str:
    """A new CSV file with a small text in another encoding."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}/part.csv")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(text.encode(encoding)))
    out.close()
    return path.getParent().toString()


def declared(spark, sf_dir):
    path = written(spark, _table(spark, sf_dir, "customer"))
    return run(spark, CUSTOMER + f'v out = load("{path}") :: Customer')


def by_position(spark, sf_dir):
    """Other names than the file's, and fewer: columns are matched by position, surplus ones stay with the type of their cells."""
    path = written(spark, _table(spark, sf_dir, "customer"))
    return run(spark, f'type Short = {{ id: int, label: string }}\nv out = load("{path}") :: Short')


def undeclared(spark, sf_dir):
    path = written(spark, _table(spark, sf_dir, "part").withColumn("late", F.when(F.col("p_partkey") == 150, 1.5).otherwise(F.lit(2)).cast("string")))
    return run(spark, f'v out = load("{path}") :: Nothing')


def quoted(spark, sf_dir):
    """Cells with separators, quotes and line breaks."""
    odd = F.concat(F.col("n_name"), F.lit(', "quoted"\nnext line'))
    path = written(spark, _table(spark, sf_dir, "nation").withColumn("note", odd))
    return run(spark, f'v out = load("{path}") :: Nothing')


def korean(spark, sf_dir):
    """Korean headers in code page 949; the declared names replace them."""
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows at every size
    text = "번호,이름,지역\n" + "".join(f"{r[0]},{r[1]} 나라,{r[2]}\n" for r in rows)
    path = written_as(spark, text, "cp949")
    return run(spark, f'type Nation = {{ n_nationkey: int, n_name: string, n_regionkey: int }}\nv out = load("{path}") :: Nation')


def _dirty(spark, sf_dir):
    k = F.col("event_id") % 7
    value = F.when(k == 0, "-").when(k == 1, "점검중").when(k == 2, "N/A").when(k == 3, "abc").when(k == 4, " ").otherwise(F.col("value").cast("string"))
    return written(spark, _table(spark, sf_dir, "events").select("event_id", "event_type", value.alias("value")))


def dirty(spark, sf_dir):
    """Cells that mean "missing", and cells that are no numbers."""
    return run(spark, f'type Event = {{ event_id: int, event_type: string, value: Option<float> }}\nv out = load("{_dirty(spark, sf_dir)}") :: Event')


def violations(spark, sf_dir):
    session = Session(spark)
    session.run(f'type Event = {{ event_id: int, event_type: string, value: float }}\nv out = load("{_dirty(spark, sf_dir)}") :: Event')
    return spark.createDataFrame(list(session.violations("out").items()), "name string, nulls long")


def chart(spark, sf_dir):
    """The data of a chart's specification."""
    session = Session(spark)
    session.run(f'v t = load("{sf_dir}/customer.parquet") :: Customer |> groupBy("c_mktsegment") |> count("c_custkey")\nt |> chart {{ type: bar x: c_mktsegment y: c_custkey }}')
    return spark.createDataFrame([(r["c_mktsegment"], r["c_custkey"]) for r in session.charts[0]["data"]], "c_mktsegment string, c_custkey long")


def sampled(spark, sf_dir):
    """How many rows of a sample there are, how many different ones, and how many are rows of the table."""
    out = run(spark, f'v out = load("{sf_dir}/customer.parquet") :: Customer |> sample(25, seed: 3)')
    whole = _table(spark, sf_dir, "customer").withColumn("there", F.lit(1))
    return out.join(whole, out.columns, "left").agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("different"), F.sum("there").alias("there"))


FILES: dict[str, FileQuery] = {
    "csv_declared": FileQuery(declared, _CUSTOMER_SQL),
    "csv_by_position": FileQuery(by_position, _CUSTOMER_SQL.replace("c_custkey, c_name,", "c_custkey as id, c_name as label,")),
    "csv_undeclared": FileQuery(undeclared, "select p_partkey, p_name, p_brand, p_type, p_size::bigint as p_size, p_retailprice, case when p_partkey = 150 then 1.5 else 2 end::double as late from part"),
    "csv_quoted": FileQuery(quoted, "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey, n_name || ', \"quoted\"' || chr(10) || 'next line' as note from nation"),
    "csv_korean": FileQuery(korean, "select n_nationkey::bigint as n_nationkey, n_name || ' 나라' as n_name, n_regionkey::bigint as n_regionkey from nation"),
    "csv_dirty": FileQuery(dirty, "select event_id, event_type, case when event_id % 7 > 4 then value end as value from events"),
    "csv_violations": FileQuery(violations, "select 'value' as name, count(*) as nulls from events where event_id % 7 <= 4 or value is null"),
    "chart_data": FileQuery(chart, "select c_mktsegment, count(*) as c_custkey from customer group by 1"),
    "sample_rows_belong": FileQuery(sampled, "select 25::bigint as n, 25::bigint as different, 25::bigint as there"),
}
