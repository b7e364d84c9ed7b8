"""A PySpark-native analytics engine for nested, key-sorted tables."""
