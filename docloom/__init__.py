"""Domain-aware document retrieval analytics as plain Spark jobs."""

__version__ = "0.1.0"
