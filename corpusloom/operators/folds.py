"""Ordered folds: one pass over each key's rows, with a small state carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame


def fold_in_order(df: DataFrame, key: str, order: list[Column | str], columns: list[str], schema: str, *, start: Callable[[], Any], step: Callable[..., tuple[Any, list[tuple]]], finish: Callable[[Any], list[tuple]]) -> DataFrame:
    """Rows (key, ...) that ``step`` and ``finish`` give for each key.

    ``step(state, *values)`` gets the named columns of the next row and returns the new state
    and rows to put out; ``finish(state)`` gives the last ones. Keys are sorted inside
    partitions, where sorting may spill, and rows come in batches: a key's history is never
    in memory, whatever its length. Rows with a null key belong to no history and are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in schema.split(", ")]
        now, state, some = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for one, *values in batch.itertuples(index=False, name=None):
                if not some or one != now:
                    if some:
                        out += [(now, *r) for r in finish(state)]
                    now, state, some = one, start(), True
                state, new = step(state, *values)
                out += [(now, *r) for r in new]
            yield pd.DataFrame(out, columns=names)
        if some:
            yield pd.DataFrame([(now, *r) for r in finish(state)], columns=names)

    rows = df.where(df[key].isNotNull()).repartition(key).sortWithinPartitions(key, *order).select(key, *columns)
    return rows.mapInPandas(run, schema)
