"""The queries of this package and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("sharding", "line_dedup", "packing", "chat", "decontamination", "substring_dedup", "pii", "toxicity", "near_dedup", "exact_dedup", "phrases", "whitening", "html_text")


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"quirework.llm.{m}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
