"""Spark-native analytics for discrete token grids, the media around them, and their evaluation."""

__version__ = "0.1.0"
