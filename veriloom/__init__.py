"""veriloom: a PySpark-native engine for document evidence tables."""

__version__ = "0.1.0"
