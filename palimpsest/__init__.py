"""Document analytics on Spark: bytes in, a typed columnar model, DataFrame operators over it."""

__version__ = "0.1.0"
