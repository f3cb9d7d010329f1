"""Readers of rasters and the writer of the archive."""
