"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from tidewrack.plans import analysis, ecology, inference, library, models, ordination, relational, selection  # noqa: F401  they register their queries
from tidewrack.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "diversity_indices"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
