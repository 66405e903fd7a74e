"""Every query of the engine and its SQL, by name."""

from __future__ import annotations

from lodestar.plans import arrivals, asking, clusters, events_log, graphs, intake, intents, reports, review, rules, search, star, uploads, walks

_MODULES = (search, rules, graphs, events_log, star, uploads, intents, clusters, walks, intake, reports, arrivals, asking, review)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
