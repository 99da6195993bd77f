"""Spark-native analytics over noisy, timestamped observations."""
