"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from .operators import brackets, changes, coverage, entries, exports, findings, golang, graphs, history, hotspots, imports, ledgers, paths, php, policies, records, rollups, scanners

_MODULES = (hotspots, findings, coverage, scanners, paths, rollups, changes, graphs, records, brackets, entries, policies, exports, imports, php, ledgers, golang, history)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
