"""A PySpark-native engine for building and checking training datasets."""
