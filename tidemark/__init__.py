"""Spark-native time-series and panel analytics."""
