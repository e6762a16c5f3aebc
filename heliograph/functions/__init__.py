"""Spark-native functions of the media-library engine."""
