"""Web-content and web-event analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
