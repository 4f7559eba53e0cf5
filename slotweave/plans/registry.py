"""All registered queries of the core and their SQL twins."""

from __future__ import annotations

from slotweave.plans import extras, gauges, grids, problems, problems_sql, reports, scoring, streams, truth, fields, strikes, modelling, review, stores, archive

_MODULES = (problems, reports, gauges, scoring, grids, streams, extras, truth, fields, strikes, modelling, review, stores, archive)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in _MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLES.update(getattr(_m, "ORACLES", {}))
ORACLES.update(problems_sql.ORACLES)
