"""All queries of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from ledgerlark.plans import families, mechanisms
from ledgerlark.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "families", "mechanisms"]
