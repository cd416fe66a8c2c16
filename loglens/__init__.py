"""loglens: log search, evidence maps and GC analytics as Spark jobs."""

__version__ = "0.1.0"
