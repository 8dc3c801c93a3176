"""Per-key numpy functions over rows that Spark has brought together.

Rows are hash-partitioned and sorted by the key, and each task walks its
partition in Arrow batches. Many small keys share one batch, so a key costs
microseconds and not one Python round trip. Callers bound the rows of a key.
``map_keys`` calls a function of each key, ``map_batches`` one of many keys at
once, for work that numpy does for all of them together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Columns = Mapping[str, np.ndarray]


def map_keys(
    df: DataFrame, key: str, columns: Sequence[str], fn: Callable[[str, Columns], Columns], schema: str
) -> DataFrame:
    """``fn(key, arrays)`` of every key; it returns equally long columns of ``schema``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in frames:
            if rest is not None and len(rest):
                pdf = pd.concat([rest, pdf], ignore_index=True)
            keys = pdf[key].to_numpy(dtype=object)
            cuts = np.nonzero(keys[1:] != keys[:-1])[0] + 1
            if len(cuts):
                yield work(pdf.iloc[: cuts[-1]], keys, np.concatenate([[0], cuts]))
                rest = pdf.iloc[cuts[-1]:]
            else:
                rest = pdf
        if rest is not None and len(rest):
            yield work(rest, rest[key].to_numpy(dtype=object), np.array([0, len(rest)]))

    def work(pdf: pd.DataFrame, keys: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
        arrays = {c: pdf[c].to_numpy() for c in columns}
        parts = [
            fn(keys[a], {c: v[a:b] for c, v in arrays.items()}) for a, b in zip(cuts[:-1], cuts[1:])
        ]
        names = list(parts[0])
        return pd.DataFrame({n: _stack([p[n] for p in parts]) for n in names})

    # The work per byte is high, so partitions must not be merged for being small.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = df.select(key, *columns).repartition(partitions, key).sortWithinPartitions(key)
    return together.mapInPandas(run, schema)


def map_batches(
    df: DataFrame, key: str, columns: Sequence[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``fn(batch)`` of batches that hold all rows of each of their keys, a key's rows behind each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last key of a batch may go on in the next, so its rows wait.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, _ = encoded(batch.column(0))
            cuts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
            if held and held[-1].column(0)[-1] != batch.column(0)[0]:
                cuts = np.concatenate([[0], cuts])
            if not len(cuts):
                held.append(batch)
                continue
            last = int(cuts[-1])
            yield fn(pa.concat_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield fn(pa.concat_batches(held))

    # The work per byte is high, so partitions must not be merged for being small.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = df.select(key, *columns).repartition(partitions, key).sortWithinPartitions(key)
    return together.mapInArrow(run, schema)


def encoded(column: pa.Array, ordered: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Whole numbers of the values and the values they stand for, in order of appearance or ascending; null is a value."""
    words = column.dictionary_encode(null_encoding="encode")
    codes, values = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    if not ordered:
        return codes, values
    order = pc.sort_indices(values).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[codes], values.take(pa.array(order))


def _stack(parts: list) -> np.ndarray | list:
    if isinstance(parts[0], list):
        return [x for p in parts for x in p]
    return np.concatenate(parts)


def median_along(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """Median of the values that are not NaN; one sort, which puts NaN last."""
    ordered = np.sort(x, axis=axis)
    count = np.count_nonzero(~np.isnan(x), axis=axis, keepdims=True)
    low = np.take_along_axis(ordered, np.maximum(count - 1, 0) // 2, axis)
    high = np.take_along_axis(ordered, np.minimum(count // 2, x.shape[axis] - 1), axis)
    middle = np.where(count > 0, (low + high) / 2, np.nan)
    return np.squeeze(middle, axis=axis)
