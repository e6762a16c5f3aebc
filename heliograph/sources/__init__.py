"""Spark-native sources of the media-library engine."""
