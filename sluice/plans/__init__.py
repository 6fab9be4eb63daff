"""Helpers that shape plans: lineage cuts in shared storage and the iteration driver."""
