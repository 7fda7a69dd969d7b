"""A Spark-native engine for linking records."""
