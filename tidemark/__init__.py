"""Spark-native analytics over source units, dependency graphs and change history."""
