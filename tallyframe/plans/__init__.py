"""Registered queries over the driver tables, grouped by layer."""

from tallyframe.plans import decision, domain, estimation, evidence, relational, resolution  # noqa: F401
from tallyframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
