"""Named queries over the supplied tables, each with a SQL twin where one exists."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "summary_queries",
    "text_queries",
    "planning_queries",
    "report_queries",
    "judge_queries",
    "validation_queries",
    "source_queries",
    "flow_queries",
)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"{__name__}.{name}"), attribute)
        repeated = merged.keys() & part.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict[str, str]:
    return _merged("SQL")
