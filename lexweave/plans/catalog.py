"""All queries of the core package, with their SQL where there is one."""

from __future__ import annotations

from lexweave.plans import answers, documents, ingest, records, references, retrieval, state, structure

MODULES = [references, documents, retrieval, state, ingest, structure, answers, records]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
