"""A PySpark-native engine for multi-signal time-series highlights: DataFrame in, DataFrame out."""
