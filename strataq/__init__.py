"""strataq: a Spark-first engine for code-graph analytics."""

__version__ = "0.1.0"
