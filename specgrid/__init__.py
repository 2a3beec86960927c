"""Spark-native analytics for imaging-spectrometer pixels, flightlines and field sites."""
