"""Merging overlapping snapshots as they arrive.

Field consensus does not depend on the order of its input, so the batch aggregate runs unchanged on
a stream of late and repeated snapshots: the state per key is a minimum and a maximum per field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyframe.operators.consensus import field_consensus


def merge_snapshots(stream: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The agreed record of every key seen so far; write it in complete or update mode."""
    return field_consensus(stream, keys, fields)
