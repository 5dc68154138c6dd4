"""Registered queries of the training-data operators, one per operator, with SQL twins where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "language_queries",
    "dedup_queries",
    "quality_queries",
    "model_queries",
    "warc_queries",
    "mixing_queries",
    "sketch_queries",
    "ann_queries",
    "packing_queries",
    "license_queries",
    "ranked_queries",
    "token_queries",
    "trie_queries",
)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"scorelake.llm.{name}"), attribute))
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict[str, str]:
    return _merged("SQL")
