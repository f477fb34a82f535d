"""Readers and writers: untrusted text, nested feeds, partitioned parquet with manifests."""
