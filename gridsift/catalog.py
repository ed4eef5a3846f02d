"""All named queries over the driver's tables, with the DuckDB SQL that must agree with them."""

from __future__ import annotations

import importlib

AREAS: tuple[str, ...] = ("ground", "masks", "sites", "search", "live", "reports", "full", "survey", "texts")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for area in AREAS:
        part = getattr(importlib.import_module(f"gridsift.plans.{area}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
