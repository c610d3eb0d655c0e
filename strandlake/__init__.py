"""Spark-native analytics for barcoded sequencing data."""
