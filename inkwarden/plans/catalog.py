"""All queries of the engine; importing the modules registers them."""

from __future__ import annotations

from . import engine, privacy, retrieval, scoring  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
