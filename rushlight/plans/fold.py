"""Keyed ordered fold for recurrences that no window expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(
    df: DataFrame,
    key: str,
    order: list[str],
    start: Callable[[], dict],
    step: Callable[[dict, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Run ``step(state, rows)`` along each key in order, carrying ``state`` between batches.

    Rows are streamed from a sorted, spillable shuffle; a task holds one Arrow batch and the
    state of the key it is walking, so memory does not grow with the key. A key that spans
    batches keeps its state in the iterator.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            for value, rows in batch.groupby(key, sort=False, dropna=False):
                value = None if pd.isna(value) else value  # a null key is a key of its own
                if state is None or value != current:
                    current, state = value, start()
                yield step(state, rows)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(walk, schema)
