"""Insurance claims lakehouse on PySpark: events to Bronze, Silver, Gold and served queries."""

__version__ = "0.1.0"
