"""Whole groups of rows as NumPy arrays.

Rows are dealt by their keys and sorted by them in one exchange. A task reads its rows batch by batch and hands runs of
whole groups, many at once, to a function of arrays; only the last, open group is carried on to the next batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of the arrays that are made of groups together: 32 MB.
CELLS = 4_000_000

Arrays = dict[str, np.ndarray]


def group_starts(columns: Arrays, keys: list[str]) -> np.ndarray:
    """Where each group begins, in rows sorted by their keys."""
    n = len(columns[keys[0]])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= columns[k][1:] != columns[k][:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], cells: int) -> Iterator[tuple[Arrays, np.ndarray]]:
    """(columns, where each group begins), of whole groups that take `cells` cells each."""
    most, held = max(1, CELLS // cells), None
    for batch in batches:
        new = {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names)}
        held = new if held is None else {c: np.concatenate([held[c], v]) for c, v in new.items()}
        starts = group_starts(held, keys)
        if len(starts) > most or len(held[keys[0]]) > CELLS:
            last = starts[-1]
            yield from _slices({c: v[:last] for c, v in held.items()}, starts[:-1], most)
            held = {c: v[last:] for c, v in held.items()}
    if held is not None and len(held[keys[0]]):
        yield from _slices(held, group_starts(held, keys), most)


def _slices(columns: Arrays, starts: np.ndarray, most: int) -> Iterator[tuple[Arrays, np.ndarray]]:
    ends = np.append(starts, len(next(iter(columns.values()))))
    for a in range(0, len(starts), most):
        b = min(a + most, len(starts))
        yield {c: v[ends[a] : ends[b]] for c, v in columns.items()}, starts[a:b] - ends[a]


def by_groups(df: DataFrame, keys: list[str], cells: int, run: Callable[[Arrays, np.ndarray], Arrays], schema: str) -> DataFrame:
    """run(columns, starts) -> columns, on runs of whole groups with equal `keys` (numbers, never null)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in whole_groups(batches, keys, cells):
            out = run(columns, starts)
            yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(scan, schema)


def scattered(columns: Arrays, starts: np.ndarray, cells: int, place: str, value: str) -> np.ndarray:
    """An array of `cells` cells for each group, with the values at their places; values of equal places add up."""
    sizes = np.diff(np.append(starts, len(columns[place])))
    at = np.repeat(np.arange(len(starts)) * cells, sizes) + columns[place]
    return np.bincount(at, columns[value], len(starts) * cells).reshape(len(starts), cells)
