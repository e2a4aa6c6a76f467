"""All queries of the library itself."""

from __future__ import annotations

from . import inputs, programs, relational, scalar, tools  # noqa: F401  (each registers its queries)
from .registry import ORACLES, QUERIES

flagship = relational.flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
