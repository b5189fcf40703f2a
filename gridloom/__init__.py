"""Windowed, overview-aware raster analytics expressed as Spark DataFrame plans."""
