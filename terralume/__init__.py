"""Bi-temporal raster analytics on Spark: scenes as pixel tables, everything else as DataFrame plans."""
