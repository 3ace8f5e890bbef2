"""A Spark-native engine for querying text evidence."""
