"""Quillon: a PySpark-native engine for retrieval over document corpora and for the analysis of its runs."""

__version__ = "0.1.0"
