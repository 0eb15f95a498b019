"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from . import decontaminate, langid, neighbours, packing, quality, secrets, sharding, simhash, substring, toxicity

MODULES = (simhash, packing, neighbours, substring, langid, quality, sharding, decontaminate, toxicity, secrets)


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= getattr(m, "ORACLE_SQL", {})
    return out
