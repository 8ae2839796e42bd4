"""Spark-first engine for small, clean, weighted training subsets of large dirty tables."""
