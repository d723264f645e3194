"""gridweave: a PySpark-native analytics engine for electricity-grid data and text corpora."""
