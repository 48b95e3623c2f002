"""Row-wise pipelines over files as they arrive (Structured Streaming).

Steps that look at one row at a time run on a stream exactly as on a table.  Others need the whole
input and are refused here; aggregate the streamed output with an ordinary program instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as S
from pyspark.sql.streaming import DataStreamWriter

from ..lang import tree as T
from ..lang.errors import ScriptError
from ..operators.relational import ROWWISE, SIMPLE


def transform(df: DataFrame, ops: tuple[T.Op, ...]) -> DataFrame:
    for op in ops:
        if op.name not in ROWWISE or (op.name == "count" and op.column is not None):
            raise ScriptError("type", f"{op.name} needs the whole input and cannot run on a stream", op.line)
        if op.name in SIMPLE:
            df = SIMPLE[op.name](df, op)
    return df


def follow(spark: SparkSession, folder: str, schema: S.StructType, ops: tuple[T.Op, ...], files_per_batch: int = 1000) -> DataFrame:
    """Parquet files that arrive in ``folder``, transformed."""
    return transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder), ops)


def append_to(df: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends the stream to Parquet, exactly once."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
