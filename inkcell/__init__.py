"""Spark-native conversion, structuring and comparison of print and braille document corpora."""
