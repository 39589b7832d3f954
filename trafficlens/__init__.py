"""A PySpark-native engine for windowed questions over network flow events."""
