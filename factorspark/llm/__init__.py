"""Training-data operators: near-duplicates, filters, formatting, search and mixing.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` below are
picked up by ``__spark_entry__`` when the subpackage is present.
"""

from __future__ import annotations

from factorspark.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
