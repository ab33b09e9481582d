"""A Spark-native engine for posting-style records."""
