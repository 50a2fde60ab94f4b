"""All registered queries."""

from workload import concept_queries, index_queries, text_queries, vector_queries

_GROUPS = (text_queries, vector_queries, concept_queries, index_queries)
QUERIES = {name: fn for g in _GROUPS for name, fn in g.QUERIES.items()}
SQL = {name: text for g in _GROUPS for name, text in g.SQL.items()}
