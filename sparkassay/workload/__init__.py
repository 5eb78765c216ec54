"""The registered queries, each with the SQL that answers the same where SQL can express it."""

from sparkassay.workload import knowledge, media, plans, privacy, quality, sources, stats

_MODULES = (quality, stats, privacy, media, knowledge, sources, plans)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
