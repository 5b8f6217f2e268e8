"""All registered queries and their SQL, by module."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("q_catalog", "q_text", "q_telemetry", "q_helpers")


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"quirework.plans.{m}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
