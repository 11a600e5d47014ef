"""Queries over the test tables, each paired with equivalent SQL where there is one."""

from workload.registry import ORACLES, QUERIES

from workload import commerce, files, ingest, maintenance, modelling, reporting, scoring, sessions, staged  # noqa: E402,F401

__all__ = ["ORACLES", "QUERIES"]
