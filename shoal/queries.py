"""Every library query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .operators import boxes, changes, details, filters, groups, ranking, similarity, stats, timeline, vectorindex, windows  # noqa: F401  each module registers its queries
from .functions import names, vectors  # noqa: F401
from .plans import fulltext, search  # noqa: F401
from .plans import names as name_index  # noqa: F401
from .sources import files  # noqa: F401
from .sources.views import ORACLE_SQL, QUERIES

from .streaming import indexing, queue  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
