"""tidewell: a PySpark-native read layer over replicated tables, and its data-processing operators."""
