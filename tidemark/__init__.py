"""A Spark-native engine for versioned, ordered key/value data."""
