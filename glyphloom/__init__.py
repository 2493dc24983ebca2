"""Spark-native text analytics: Unicode processing, text security, corpus operators."""
