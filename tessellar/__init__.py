"""Spark-native analytics over industrial-safety documents."""
