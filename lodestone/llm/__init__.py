"""Operators for preparing training data: each module holds one operator and its query."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """Queries and their checks in SQL, by name."""
    from lodestone.llm import (  # noqa: F401
        html_render,
        lexical_packing,
        multiset_hash,
        nb_svm,
        negative_mining,
        personal_data,
        piece_coding,
        registry,
        secret_scan,
        set_join,
        token_alignment,
        toxicity,
        uniform_threshold,
        url_rules,
    )

    return registry.QUERIES, registry.CHECKS
