"""tilespark: raster, mask, patch and training-telemetry analytics as Spark DataFrames."""
