"""All registered queries of the library's own operators."""

from __future__ import annotations

from .plans import corpus, documents, metrics, models, studies

FLAGSHIP = "document_scan"
_PLANS = (documents, corpus, metrics, models, studies)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
