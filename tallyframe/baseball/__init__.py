"""The generic operators configured for baseball event tables."""
