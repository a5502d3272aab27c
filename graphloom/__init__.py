"""graphloom: Spark-first analytics over typed property graphs of a software estate."""

__version__ = "0.1.0"
