"""All queries of the core and their SQL."""

from __future__ import annotations

from frameflow.plans import matching, messages, particles, pipelines, pixels, relational

MODULES = [messages, particles, matching, pixels, pipelines, relational]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
