"""A PySpark-native engine for hybrid retrieval and slicing of paged documents."""
