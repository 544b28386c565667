"""Entity profiles, clustering and similarity search as Spark DataFrame operators."""

__version__ = "0.1.0"
