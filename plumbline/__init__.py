"""Spark jobs for GNSS correction-network quality monitoring."""

__version__ = "0.1.0"
