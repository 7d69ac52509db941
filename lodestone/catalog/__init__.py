"""Registered queries over the test tables, each with its check in SQL."""

from __future__ import annotations

from typing import NamedTuple


class Catalog(NamedTuple):
    queries: dict
    checks: dict


def load() -> Catalog:
    """Import every module that registers queries."""
    from lodestone.catalog import evaluation, ingest, registry, retrieval, textops  # noqa: F401

    return Catalog(registry.QUERIES, registry.CHECKS)
