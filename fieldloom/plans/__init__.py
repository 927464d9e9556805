"""Registered queries: ``QUERIES`` by name, and ``ORACLES``, the same in SQL."""

from fieldloom.plans import accuracy, imagery, polygons, shapes, vectors  # noqa: F401
from fieldloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
