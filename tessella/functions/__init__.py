"""Column functions: tiles, georeferencing, nodata, pixels."""
