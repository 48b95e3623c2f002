"""A Spark-native batch analytics engine: a small pipeline language and a fluent API over DataFrames."""

__version__ = "0.1.0"
