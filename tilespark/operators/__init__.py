"""Raster, mask, patch, sampling and evaluation operators: DataFrame in, DataFrame out."""
