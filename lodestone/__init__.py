"""A Spark-native engine for dataset quality, evaluation and tracking."""
