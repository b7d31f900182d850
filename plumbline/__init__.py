"""Spark-native analytics over decoded engineering drawings."""
