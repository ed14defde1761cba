"""Registered queries over the driver tables, with their SQL oracles."""

from . import areas, files, modelling, records, tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
