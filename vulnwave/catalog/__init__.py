"""Registered queries over the test tables and the SQL they are checked against."""

from . import feeds, ingest, models, reporting, scoring, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
