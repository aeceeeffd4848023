"""A PySpark-native engine for evaluating predictions on grouped measurements."""
