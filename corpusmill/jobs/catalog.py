"""All registered queries and their SQL."""

from __future__ import annotations

from corpusmill.jobs import answer_jobs, code_jobs, contract_jobs, eval_jobs, fact_jobs, field_jobs, retention_jobs, search_jobs, selection_jobs, store_jobs, strategy_jobs, text_jobs, visibility_jobs

_MODULES = (search_jobs, text_jobs, fact_jobs, eval_jobs, selection_jobs, contract_jobs, field_jobs, strategy_jobs, code_jobs, store_jobs, visibility_jobs, answer_jobs, retention_jobs)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: sql for m in _MODULES for k, sql in m.ORACLES.items()}
