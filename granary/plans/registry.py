"""Every query of the library and its SQL twin, by name."""

from __future__ import annotations

from . import canvas, chunking, clusters, incremental, parsing, relations, retrieval, scalars, scans, search  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
