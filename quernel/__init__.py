"""quernel: declarative table access, text search, geo search and skew-safe
analytics as lazy PySpark plans."""

__version__ = "0.1.0"
