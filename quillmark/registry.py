"""Registry of the engine's own queries: name -> callable, and name -> SQL for the oracle."""

from __future__ import annotations

from quillmark import queries_files, queries_metrics, queries_misc, queries_records, queries_reports

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (queries_metrics, queries_records, queries_misc, queries_files, queries_reports):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
