"""All queries of the subpackage, by name, with their SQL."""

from __future__ import annotations

from tidewatch.llm import queries_a, queries_b, queries_c, queries_d

QUERIES = {**queries_a.QUERIES, **queries_b.QUERIES, **queries_c.QUERIES, **queries_d.QUERIES}
SQL = {**queries_a.SQL}
