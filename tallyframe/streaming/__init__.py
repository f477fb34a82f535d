"""Incremental use of the merging operators."""
