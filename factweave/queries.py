"""Registered queries of the fact engine and their SQL."""

from factweave.plans import batches, facts, governance, lookups, records

_MODULES = (facts, governance, lookups, records, batches)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
