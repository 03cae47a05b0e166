"""Registered queries (one per operator family) and their oracles."""

from storelens.plans.catalog import ORACLES, QUERIES, register

# Importing the modules registers their queries.
from storelens.plans import retail, profiles, stores, pricing, segments, clusters, models  # noqa: F401,E402

__all__ = ["QUERIES", "ORACLES", "register"]
