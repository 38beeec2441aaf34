"""Spark-first analytics engine: collection algebra, SQL, streaming and data-preparation operators."""

__version__ = "0.1.0"
