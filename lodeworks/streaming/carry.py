"""Fill-forward over a stream of ordered rows, with state by key (beyond the batch operators)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def carry_stream(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value, carried) for a stream with string value: carried is the last non-null value of the key so far.

    Rows of a key are taken in order within each micro-batch; the last value is kept as state between them.
    """

    def step(ids: tuple, batches: Iterator, state) -> Iterator:
        last = state.get[0] if state.exists else None
        import pandas as pd

        for frame in (pd.concat(list(batches)).sort_values(order),):
            carried = frame[value].ffill()
            if last is not None:
                carried = carried.fillna(last)
            if len(carried) and pd.notna(carried.iloc[-1]):
                last = carried.iloc[-1]
            yield frame[[key, order, value]].assign(carried=carried)
        state.update((last,))

    kinds = dict(rows.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} string, carried string"
    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(step, out, "last string", "append", "NoTimeout")
