"""A PySpark-native engine for transcript and signal analytics."""
