"""Readers of ledger exports and the canonical ledger table."""
