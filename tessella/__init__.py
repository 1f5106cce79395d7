"""Spark-native analytics over tagged, fragmented content."""
