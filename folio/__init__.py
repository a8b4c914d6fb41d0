"""Spark-native analytics for general-ledger data."""
