"""Operators on the canonical ledger: DataFrame in, DataFrame out."""
