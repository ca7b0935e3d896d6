"""Incremental operators on streams of entries; beyond what batches need, with the same results."""
