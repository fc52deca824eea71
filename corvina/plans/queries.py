"""All core queries by name, and the SQL that states the same result."""

from __future__ import annotations

from corvina.operators import nested
from corvina.plans import reading, resolving, serving

QUERIES = {**serving.QUERIES, **resolving.QUERIES, **reading.QUERIES, **nested.QUERIES}
SQL: dict[str, str] = {**serving.SQL, **resolving.SQL, **reading.SQL, **nested.SQL}
