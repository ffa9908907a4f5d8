"""Media catalogue on Spark: ingest, hierarchy, browse, search, change streams."""

__version__ = "0.1.0"
