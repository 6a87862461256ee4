"""All queries of the library, by name, with their SQL.

The SQL is written on its own, over the input tables; it shares no logic with the plans, only tables of
fixed values.
"""

from __future__ import annotations

from .plans import assistant_queries, audit_queries, document_queries, evidence_queries, extraction_queries, retrieval_queries, shipment_queries, text_queries

MODULES = (shipment_queries, text_queries, document_queries, retrieval_queries, audit_queries, assistant_queries, evidence_queries, extraction_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
