"""All registered queries and their SQL twins."""

from __future__ import annotations

from rankloom.plans import comparison, curation, retrieval, structures

QUERIES = {**retrieval.QUERIES, **comparison.QUERIES, **curation.QUERIES, **structures.QUERIES}
SQL = {**retrieval.SQL, **comparison.SQL, **curation.SQL, **structures.SQL}
