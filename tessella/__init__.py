"""Tessella: a Spark-native raster tiling engine."""

__version__ = "0.1.0"
