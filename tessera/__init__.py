"""A relational-algebra engine on Spark."""

__version__ = "0.1.0"
