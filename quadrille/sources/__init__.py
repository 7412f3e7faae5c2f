"""Readers of vector, raster and archive formats."""
