"""Spark-native analytics over append-only ledger data."""
