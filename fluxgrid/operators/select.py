"""Selection, trimming and padding: maps of places, axis by axis."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid, as_shape, axes_of
from fluxgrid.plans.op import LINEAR, ORTH_PROJECTION, SQUARE, Op


def _rows(x: Grid, axis: int, places: Column) -> Grid:
    """Each row once for every place (an array) that its place on the axis goes to."""
    name = f"i{axis}"
    df = x.df.withColumn("__to", F.explode(places)).drop(name).withColumnRenamed("__to", name)
    return Grid(df.select("s", *axes_of(x.rank), "v"), x.shape)


def _table(pairs: dict[int, list[int]], n: int, at: Column) -> Column:
    """The array of places that `at` goes to, from a table given here."""
    return F.get(F.array(*(F.array(*map(F.lit, pairs.get(k, []))).cast("array<long>") for k in range(n))), at.cast("int"))


class SubSample(Op):
    """Some places of each axis: a number (kept as an axis of one), a slice, places, or a list of booleans. Places may
    recur; the adjoint then adds up."""

    def __init__(self, dim, *indices):
        dim = as_shape(dim)
        indices = [*indices, *[slice(None)] * (len(dim) - len(indices))]
        self.places = [self._list(n, i) for n, i in zip(dim, indices, strict=True)]
        self.slices = [i if isinstance(i, slice) else None for i in indices]
        if any(not 0 <= k < n for n, p in zip(dim, self.places, strict=True) for k in p):
            raise ValueError("an index is out of range")
        codim = tuple(len(p) for p in self.places)
        super().__init__(dim, codim, SQUARE if codim == dim else LINEAR)
        twice = [max(p.count(k) for k in set(p)) if not isinstance(p, range) else 1 for p in self.places]
        self.recurs = math.prod(twice) > 1
        self.lipschitz = math.sqrt(math.prod(twice))

    @staticmethod
    def _list(n: int, index) -> Sequence[int]:
        if isinstance(index, slice):
            return range(n)[index]
        if isinstance(index, bool) or not isinstance(index, Sequence):
            return [int(index) % n] if -n <= int(index) < n else [n]
        if len(index) and all(isinstance(k, bool) for k in index):
            return [k for k, keep in enumerate(index) if keep]
        return [int(k) % n if -n <= int(k) < n else n for k in index]

    def _axis(self, x: Grid, k: int, back: bool) -> Grid:
        p, name = self.places[k], F.col(f"i{k}")
        if isinstance(p, range):
            if back:
                to = name * p.step + p.start
                return Grid(x.df.select("s", *(to.cast("long").alias(c) if c == f"i{k}" else c for c in axes_of(x.rank)), "v"), x.shape)
            if p == range(self.dim[k]):
                return x
            low, high = min(p), max(p)
            df = x.df.where((name >= low) & (name <= high) & ((name - p.start) % abs(p.step) == 0))
            to = (name - p.start) * int(math.copysign(1, p.step))
            to = to if abs(p.step) == 1 else F.floor(to / abs(p.step))
            return Grid(df.select("s", *(to.cast("long").alias(c) if c == f"i{k}" else c for c in axes_of(x.rank)), "v"), x.shape)
        if back:
            return _rows(x, k, _table({j: [i] for j, i in enumerate(p)}, len(p), name))
        to: dict[int, list[int]] = {}
        for j, i in enumerate(p):
            to.setdefault(i, []).append(j)
        return _rows(Grid(x.df.where(name.isin(*to)), x.shape), k, _table(to, self.dim[k], name))

    def apply(self, x):
        for k in range(x.rank):
            x = self._axis(x, k, False)
        return Grid(x.df, self.codim)

    def adjoint(self, y):
        for k in range(y.rank):
            y = self._axis(y, k, True)
        y = Grid(y.df, self.dim)
        return y.summed() if self.recurs else y

    def gram(self):
        return super().gram() if self.recurs else _Masked(self)

    def pinv(self, y, damp=0.0, **fit):
        return super().pinv(y, damp, **fit) if self.recurs else self.adjoint(y).scale(1 / (1 + damp))


class _Masked(Op):
    """Keeps the selected places, 0 elsewhere."""

    lipschitz = 1.0

    def __init__(self, sub: SubSample):
        super().__init__(sub.dim, sub.dim, ORTH_PROJECTION, "Mask")
        self.sub = sub

    def apply(self, x):
        return self.sub.adjoint(self.sub.apply(x))


def _widths(width, rank: int) -> list[tuple[int, int]]:
    if isinstance(width, int):
        return [(width, width)] * rank
    out = [(int(w), int(w)) if isinstance(w, int) else (int(w[0]), int(w[1])) for w in width]
    if len(out) != rank:
        raise ValueError("a width for each axis")
    return out


def Trim(dim, width) -> SubSample:  # noqa: N802
    """Without (head, tail) places of each axis."""
    dim = as_shape(dim)
    widths = _widths(width, len(dim))
    if any(a < 0 or b < 0 or a + b >= n for n, (a, b) in zip(dim, widths, strict=True)):
        raise ValueError("the widths leave nothing")
    return SubSample(dim, *(slice(a, n - b) for n, (a, b) in zip(dim, widths, strict=True)))


MODES = ("constant", "wrap", "reflect", "symmetric", "edge")


class Pad(Op):
    """More places around each axis: zeros (constant), or the values that wrap, reflect, symmetric or edge put there.
    Axes are independent, so corners follow from filling one axis after the other."""

    def __init__(self, dim, width, mode="constant"):
        dim = as_shape(dim)
        self.widths = _widths(width, len(dim))
        self.modes = [mode] * len(dim) if isinstance(mode, str) else list(mode)
        for n, (a, b), m in zip(dim, self.widths, self.modes, strict=True):
            if m not in MODES:
                raise ValueError(f"unknown mode {m}")
            most = {"wrap": n, "symmetric": n, "reflect": n - 1}.get(m, math.inf)
            if min(a, b) < 0 or max(a, b) > most:
                raise ValueError(f"widths {(a, b)} do not fit {m} on {n} places")
        codim = tuple(n + a + b for n, (a, b) in zip(dim, self.widths, strict=True))
        super().__init__(dim, codim, SQUARE if codim == dim else LINEAR)
        self.lipschitz = math.sqrt(math.prod(self._most(n, w, m) for n, w, m in zip(dim, self.widths, self.modes, strict=True)))

    @staticmethod
    def _most(n: int, width: tuple[int, int], mode: str) -> int:
        """Places that show the same value, at most."""
        a, b = width
        if mode == "constant" or a + b == 0:
            return 1
        if mode == "edge":
            return 1 + (a + b if n == 1 else max(a, b))
        return 3 if a + b > (n - 2 if mode == "reflect" else n) and a and b else 2

    def _sources(self, i: Column, n: int, width: tuple[int, int], mode: str) -> Column:
        """Places, counted from the head of the padding, at which the value of place i shows."""
        a, b = width
        at = [i]
        if mode == "wrap":
            at += [i - n, i + n]
        elif mode == "reflect":
            at += [F.when(i > 0, -i), F.when(i < n - 1, 2 * (n - 1) - i)]
        elif mode == "symmetric":
            at += [-i - 1, 2 * n - 1 - i]
        seen = F.array(*((x + a).cast("long") for x in at))
        if mode == "edge":
            head = F.when(i == 0, F.sequence(F.lit(0), F.lit(a - 1))).otherwise(F.array()) if a else F.array()
            tail = F.when(i == n - 1, F.sequence(F.lit(a + n), F.lit(a + n + b - 1))).otherwise(F.array()) if b else F.array()
            return F.concat(seen, head.cast("array<long>"), tail.cast("array<long>"))
        return F.filter(seen, lambda j: j.isNotNull() & (j >= 0) & (j < n + a + b))

    def apply(self, x):
        for k, (n, w, m) in enumerate(zip(self.dim, self.widths, self.modes, strict=True)):
            if w == (0, 0):
                continue
            if m == "constant":
                x = Grid(x.df.withColumn(f"i{k}", F.col(f"i{k}") + w[0]), x.shape)
            else:
                x = _rows(x, k, self._sources(F.col(f"i{k}"), n, w, m))
        return Grid(x.df, self.codim)

    def adjoint(self, y):
        folds = False
        for k, (n, (a, b), m) in enumerate(zip(self.dim, self.widths, self.modes, strict=True)):
            t = F.col(f"i{k}") - a
            if m == "constant":
                y = Grid(y.df.where((t >= 0) & (t < n)), y.shape)
                to = t
            else:
                folds = folds or a + b > 0
                to = {"wrap": F.pmod(t, F.lit(n)), "edge": F.greatest(F.lit(0), F.least(F.lit(n - 1), t)), "reflect": F.when(t < 0, -t).when(t >= n, 2 * (n - 1) - t).otherwise(t), "symmetric": F.when(t < 0, -t - 1).when(t >= n, 2 * n - 1 - t).otherwise(t)}[m]
            y = Grid(y.df.withColumn(f"i{k}", to.cast("long")), y.shape)
        y = Grid(y.df, self.dim)
        return y.summed() if folds else y

    def gram(self):
        from fluxgrid.operators.linop import Identity

        return Identity(self.dim) if set(self.modes) == {"constant"} else super().gram()

    def cogram(self):
        return Trim(self.codim, self.widths).gram() if set(self.modes) == {"constant"} else super().cogram()
