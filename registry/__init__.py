"""Every registered query with its SQL."""

from . import robust, tables, temporal, windows  # noqa: F401  (importing registers)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
