"""A DataFrame engine for raster time-series stacks and training-data tables."""
