"""Spark-native engine for acoustic events and event streams: every operator is a DataFrame-to-DataFrame function."""
