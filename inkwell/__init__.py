"""A PySpark-native engine for text corpora, vector retrieval, edit checks and usage ledgers."""
