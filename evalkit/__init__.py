"""evalkit: a PySpark-native analytics engine for large-scale evaluation data."""
