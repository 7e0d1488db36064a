"""A PySpark-native engine for optimizing collections of JPEG and PNG images."""
