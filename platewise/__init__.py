"""Annotated-scene analytics on PySpark: boxes, label rasters, metrics and labelling."""
