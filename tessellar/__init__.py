"""Tessellar: a PySpark-native engine for document catalogs, hybrid retrieval and search clickstreams."""

__version__ = "0.1.0"
