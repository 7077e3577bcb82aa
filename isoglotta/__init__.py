"""PySpark-native analytics for comparative pronunciation tables."""

__version__ = "0.1.0"
