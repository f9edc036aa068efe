"""All queries of the core, with their SQL twins."""

from __future__ import annotations

from samewise.plans import er_queries, general_queries

QUERIES = {**er_queries.QUERIES, **general_queries.QUERIES}
ORACLE = {**er_queries.ORACLE, **general_queries.ORACLE}
flagship = er_queries.resolve_end_to_end
