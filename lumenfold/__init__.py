"""A Spark-first engine for vector search, series analytics and data preparation."""

__version__ = "0.1.0"
