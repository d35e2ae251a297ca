"""Rows of one key at a time in Python, without a data frame for each key."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame


def by_group(rows: DataFrame, key: str, order: list[str], run: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """What `run` makes of each key's rows, in order, nulls as None; tuples of the schema's columns.

    Rows are dealt by key, sorted and streamed: a worker holds a batch and the rows of one key, and pays for conversion
    by the batch, which many small keys share.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def stream(frames):
        held: list[dict] = []
        for frame in frames:
            out: list[tuple] = []
            for value, found in groupby(frame.astype(object).where(frame.notna(), None).to_dict("records"), key=lambda r: r[key]):
                if held and held[0][key] != value:
                    out += run(held)
                    held = []
                held += found
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(run(held), columns=columns)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(stream, schema)
