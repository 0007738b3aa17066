"""A Spark-native engine for auditing documents and text corpora."""
