"""loomwork: a Spark-first engine for preparing and querying machine-learning data."""

__version__ = "0.1.0"
