"""Spark-native operators of the media-library engine."""
