"""All queries of the library and the SQL they are held against."""

from __future__ import annotations

from lexispark.plans import batch_queries, index_queries, layout_queries, review_queries, search_queries, source_queries, text_queries

QUERIES = search_queries.QUERIES | text_queries.QUERIES | layout_queries.QUERIES | review_queries.QUERIES | source_queries.QUERIES | index_queries.QUERIES | batch_queries.QUERIES
ORACLES = search_queries.ORACLES | text_queries.ORACLES | layout_queries.ORACLES | review_queries.ORACLES | source_queries.ORACLES | index_queries.ORACLES | batch_queries.ORACLES
