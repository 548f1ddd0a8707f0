"""topicspark: topic analytics over large text collections, as Spark DataFrame jobs."""

from topicspark.session import get_spark  # noqa: F401

__version__ = "0.1.0"
