"""All named queries."""

from . import catalogs, extras, objects, scoring, signals, spectral  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
