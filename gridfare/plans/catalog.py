"""Imports every query module, so that the registry is full."""

from gridfare.plans import (  # noqa: F401
    cleaning_queries,
    fare_queries,
    grid_queries,
    model_queries,
    plane_queries,
    stream_queries,
)
from gridfare.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
