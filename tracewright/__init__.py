"""Spark-native analytics over assistant transcripts and controlled experiments."""
