"""Spark-native analytics over many short, timestamped trajectories."""

__version__ = "0.1.0"
