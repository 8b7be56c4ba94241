"""Spark-native sequence classification, taxonomic profiling and data preparation."""

__version__ = "0.1.0"
