"""lumenframe: a Spark-first analytics engine of plain DataFrame -> DataFrame operators."""

__version__ = "0.1.0"
