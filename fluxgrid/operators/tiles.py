"""Cores cut into tiles with halos.

An output place o reads the input places o + low ... o + high. Each input row goes to the tiles whose outputs read it, which
is one tile but near the edges of a tile, so the one exchange moves little more than the input. A task holds tiles as
arrays, many at once, and no task needs a whole core.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid, Shape, axes_of
from fluxgrid.plans.groups import by_groups, scattered

#: Places of a tile where the reach is short; a tile has at least REACHES times its reach along each axis.
PLACES, REACHES = 1024, 4


def tile_shape(size: Sequence[int], low: Sequence[int], high: Sequence[int]) -> Shape:
    side = max(1, round(PLACES ** (1 / len(size))))
    return tuple(min(n, max(side, REACHES * (b - a))) for n, a, b in zip(size, low, high, strict=True))


def tiled(x: Grid, first: Sequence[int], size: Sequence[int], low: Sequence[int], high: Sequence[int], fn: Callable[[np.ndarray], np.ndarray]) -> Grid:
    """The outputs first ... first + size - 1 along each axis. fn: windows (tile, *places read) -> (tile, *outputs), all tiles of
    the same shape; what lies outside the outputs is dropped. Tiles that read nothing have no rows."""
    names, shape = axes_of(x.rank), tile_shape(size, low, high)
    counts = [-(-n // t) for n, t in zip(size, shape, strict=True)]
    window = [t + b - a for t, a, b in zip(shape, low, high, strict=True)]
    df, tile, place = x.df, F.lit(0).cast("long"), F.lit(0).cast("long")
    for k, name in enumerate(names):
        at = F.col(name) - int(first[k])
        from_, to = (F.floor((at - int(d)) / shape[k]) for d in (high[k], low[k]))
        from_, to = F.greatest(from_, F.lit(0)), F.least(to, F.lit(counts[k] - 1))
        df = df.where(from_ <= to).withColumn(f"__t{k}", F.explode(F.sequence(from_.cast("long"), to.cast("long"))))
        tile = tile * counts[k] + F.col(f"__t{k}")
        place = place * window[k] + (at - F.col(f"__t{k}") * shape[k] - int(low[k]))
    rows = df.select("s", tile.alias("tile"), place.cast("long").alias("place"), "v")
    cells, outputs = math.prod(window), math.prod(shape)
    inner = np.indices(shape).reshape(len(shape), -1)

    def run(columns, starts):
        arrays = scattered(columns, starts, cells, "place", "v").reshape(len(starts), *window)
        done = np.asarray(fn(arrays), float).reshape(len(starts), outputs)
        corners = np.unravel_index(columns["tile"][starts], counts)
        out = {"s": np.repeat(columns["s"][starts], outputs)}
        inside = np.ones(len(starts) * outputs, bool)
        for k, name in enumerate(names):
            at = (corners[k][:, None] * shape[k] + inner[k][None, :]).ravel()
            inside &= at < size[k]
            out[name] = at + int(first[k])
        out["v"] = done.ravel()
        return {c: v[inside] for c, v in out.items()}

    schema = ", ".join(["s long", *(f"{n} long" for n in names), "v double"])
    return Grid(by_groups(rows, ["s", "tile"], max(cells, outputs), run, schema), tuple(size))


Pass = list[tuple[tuple[int, ...], float]]


def reach(passes: list[Pass], rank: int) -> tuple[list[int], list[int]]:
    """How far all passes together read, along each axis."""
    low, high = [0] * rank, [0] * rank
    for taps in passes:
        for k in range(rank):
            at = [d[k] for d, _ in taps]
            low[k], high[k] = low[k] + min(at), high[k] + max(at)
    return low, high


def weigh(windows: np.ndarray, taps: Pass) -> np.ndarray:
    """For each place the sum of what its taps read, where all of them lie in the window."""
    rank = windows.ndim - 1
    low, high = reach([taps], rank)
    left = [n - (b - a) for n, a, b in zip(windows.shape[1:], low, high, strict=True)]
    out = np.zeros((len(windows), *left))
    for d, w in taps:
        out += w * windows[(slice(None), *(slice(o - a, o - a + n) for o, a, n in zip(d, low, left, strict=True)))]
    return out


def weigh_by_transform(windows: np.ndarray, taps: Pass) -> np.ndarray:
    """The same by transforms (overlap-save): what wraps around falls outside the places that are kept."""
    rank = windows.ndim - 1
    low, high = reach([taps], rank)
    kernel = np.zeros([b - a + 1 for a, b in zip(low, high, strict=True)])
    for d, w in taps:
        kernel[tuple(b - o for o, b in zip(d, high, strict=True))] += w
    axes, shape = list(range(1, rank + 1)), windows.shape[1:]
    spectrum = np.fft.rfftn(windows, shape, axes) * np.fft.rfftn(kernel, shape, list(range(rank)))
    whole = np.fft.irfftn(spectrum, shape, axes)
    return whole[(slice(None), *(slice(b - a, n) for n, a, b in zip(shape, low, high, strict=True)))]
