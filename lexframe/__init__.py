"""lexframe: a PySpark-native analytics engine for structured lexical data."""

__version__ = "0.1.0"
