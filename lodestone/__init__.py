"""A Spark-native engine for document analytics."""
