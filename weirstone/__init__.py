"""Weirstone: a PySpark-native engine for declared, field-aware data pipelines."""

__version__ = "0.1.0"
