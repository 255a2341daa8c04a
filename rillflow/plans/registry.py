"""All queries of the library by name."""

from __future__ import annotations

from rillflow.plans import conditioned, places, requests, shapes, storms, terrain, watersheds

MODULES = [watersheds, places, terrain, storms, conditioned, requests, shapes]


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, (_, text) in m.QUERIES.items() if text}
