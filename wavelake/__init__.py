"""A PySpark-native analytics engine for sound collections and sample streams."""
