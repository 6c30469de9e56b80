"""All queries of the engine, by importing the modules that register them."""

from __future__ import annotations

from . import files, flowing, flows, measures, ranking, relations, scalars  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
