"""All queries of the core and the SQL they are checked against."""

from __future__ import annotations

from nearpass.plans import catalogue, detection, files, problems, recovery, series, validation

_MODULES = (detection, catalogue, series, problems, validation, files, recovery)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
FLAGSHIP = "characterized"
