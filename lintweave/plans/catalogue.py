"""All queries on the driver's tables and their SQL."""

from __future__ import annotations

from . import assessments, consistency, corpus, graph, identifiers, ledger, links, machines, report, sections, services, shapes, similarity, specs, store, terms, trees

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (identifiers, sections, links, consistency, terms, similarity, ledger, graph, report, store, specs, corpus, assessments, machines, shapes, services, trees):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
