"""Operators of a large-scale training-data pipeline.  Nothing else in the
library imports this subpackage."""

from storelens.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
