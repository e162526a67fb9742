"""Every registered query and its SQL."""

from __future__ import annotations

from .plans import more, players, proofs, rejects, whole  # noqa: F401
from .plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
