"""Spark-native file-tree catalogue and duplicate analysis."""
