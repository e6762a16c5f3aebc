"""Spark-native plans of the media-library engine."""
