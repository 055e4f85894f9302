"""A PySpark-native engine for spatial scans: see README.md."""

__version__ = "0.1.0"
