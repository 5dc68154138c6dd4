"""Metrics that are Python functions over the rows of a group, for what sums and counts cannot say.

A metric is given as a state: what a batch of rows gives, how two states become one, and what the last one
says. A task keeps one state per group over all its batches and passes on only those, so a group of any size
is one small state per task; no group is ever a table in one worker.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.operators.metrics import with_levels


@dataclass(frozen=True)
class Opaque:
    """A metric by states.

    ``update`` gets the rows of one group in a batch, with the columns ``inputs``, and gives a state; ``merge``
    makes one of two, in any order; ``finish`` gives a number or None.
    """

    inputs: tuple[str, ...]
    update: Callable[[pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


def _merged(into: dict, key: tuple, states: Mapping[str, Any], metrics: Mapping[str, Opaque]) -> None:
    held = into.setdefault(key, {})
    for name, state in states.items():
        held[name] = metrics[name].merge(held[name], state) if name in held else state


def opaque_table(scored: DataFrame, metrics: Mapping[str, Opaque]) -> DataFrame:
    """Opaque metrics per (model, track) and pooled per model.

    Rows without a model take no part, rows without a track only in the pool. A metric whose inputs the table
    does not have is NULL.
    """
    known = {n: m for n, m in metrics.items() if all(c in scored.columns for c in m.inputs)}
    columns = sorted({c for m in known.values() for c in m.inputs})
    keyed = scored.filter(F.col("model_slug").isNotNull()).select("model_slug", "track", *(F.col(c).alias(f"in_{c}") for c in columns))
    group = ["model_slug", "track"]

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, rows in batch.groupby(group, dropna=False, sort=False):
                rows = rows.rename(columns=lambda c: c.removeprefix("in_"))
                _merged(held, key, {n: m.update(rows[list(m.inputs)]) for n, m in known.items()}, known)
        # A task without rows yields nothing: columns of an empty table have no Arrow type of their own.
        if held:
            yield pd.DataFrame({"model_slug": [k[0] for k in held], "track": [k[1] for k in held], "states": [pickle.dumps(v) for v in held.values()]})

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        for packed in rows["states"]:
            _merged(held, (), pickle.loads(packed), known)
        values = {n: [None if (v := m.finish(held[()][n])) is None else float(v)] for n, m in known.items()}
        return pd.DataFrame({**{c: rows[c].iloc[:1] for c in group}, **values}).astype({n: "float64" for n in values})

    partial = with_levels(keyed).mapInPandas(states, "model_slug string, track string, states binary")
    found = ", ".join(f"`{n}` double" for n in known)
    done = partial.groupBy(*group).applyInPandas(finish, "model_slug string, track string" + (f", {found}" if found else ""))
    value = {n: F.nanvl(F.col(n), F.lit(None).cast("double")) if n in known else F.lit(None).cast("double") for n in metrics}
    return done.select(*group, *(c.alias(n) for n, c in value.items()))
