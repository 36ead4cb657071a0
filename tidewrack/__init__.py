"""Spark-native analytics for ecological tables, time series and rasters."""
