"""Fourier and chirp-Z transforms, and correlation through them.

A complex value is a last axis of two places (real, imaginary part). Transforms go axis by axis over lines, many of them at
once in a task. An axis of over LINE places is split in two factors: lines of the one, turned by their twiddle factors,
an exchange, lines of the other (four-step), so that a task holds lines of about the square root of the axis. Lengths
that don't split well, and chirp-Z transforms of long axes, are convolutions with a chirp (Bluestein) on a power of
two, which does. `dft_by_join` is the transform of short axes by a join with the table of twiddle factors, without Python.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.operators.stencil import Convolve, Stencil
from fluxgrid.operators.tiles import weigh_by_transform
from fluxgrid.plans.grid import Grid, as_axes, as_shape, axes_of
from fluxgrid.plans.groups import by_groups, scattered
from fluxgrid.plans.op import LINEAR, NORMAL, Op

#: Places of an axis that is not split.
LINE = 512
#: Of the two factors of an axis, the larger is at most so many times the smaller.
UNEVEN = 64


def per_block(x: Grid, inner: list[int], out_sizes: dict[int, int], fn) -> Grid:
    """fn (array over the axes `inner`, in order -> array) on each block of the axes in `inner`, the others apart."""
    names = axes_of(x.rank)
    outer = ["s", *(n for k, n in enumerate(names) if k not in inner)]
    shape = [x.shape[k] for k in inner]
    sizes = [out_sizes.get(k, x.shape[k]) for k in inner]
    columns = ["s", *names, "v"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(shape)
        block[tuple(rows[names[k]].to_numpy() for k in inner)] = rows["v"].to_numpy()
        done = fn(block)
        at = np.indices(sizes).reshape(len(inner), -1)
        out = {names[k]: at[j] for j, k in enumerate(inner)} | dict(zip(outer, (np.full(at.shape[1], v) for v in key), strict=True))
        return pd.DataFrame(out | {"v": np.asarray(done, float).ravel()})[columns]

    schema = ", ".join(f"{c} {'double' if c == 'v' else 'long'}" for c in columns)
    return Grid(x.df.groupBy(*outer).applyInPandas(run, schema), tuple(out_sizes.get(k, n) for k, n in enumerate(x.shape)))


def waves(x: Grid) -> DataFrame:
    """Rows (keys but the last, re, im) that add up to the complex values of x."""
    c = F.col(f"i{x.rank - 1}")
    return x.df.select(*x.keys[:-1], *(F.when(c == k, F.col("v")).otherwise(0.0).alias(n) for k, n in enumerate(("re", "im"))))


def from_waves(df: DataFrame, shape) -> Grid:
    keys = ["s", *axes_of(len(shape) - 1)]
    rows = df.select(*keys, F.posexplode(F.array("re", "im")).alias("c", "v"))
    return Grid(rows.select(*keys, F.col("c").cast("long").alias(f"i{len(shape) - 1}"), "v"), tuple(shape))


def turned(df: DataFrame, angle: Column) -> DataFrame:
    """Values times exp(i angle)."""
    others, re, im, cos, sin = [c for c in df.columns if c not in ("re", "im")], F.col("re"), F.col("im"), F.cos(angle), F.sin(angle)
    return df.select(*others, (re * cos - im * sin).alias("re"), (re * sin + im * cos).alias("im"))


def by_lines(df: DataFrame, others: list[str], n: int, m: int, fn) -> DataFrame:
    """(others, line, pos, re, im): fn (values by line and place, numbers of the lines) -> m values for each line."""
    keys = [*others, "line"]

    def run(columns, starts):
        z = scattered(columns, starts, n, "pos", "re") + 1j * scattered(columns, starts, n, "pos", "im")
        done = fn(z, columns["line"][starts])
        out = {k: np.repeat(columns[k][starts], m) for k in keys}
        return out | {"pos": np.tile(np.arange(m), len(starts)), "re": done.real.ravel(), "im": done.imag.ravel()}

    schema = ", ".join([*(f"{k} long" for k in keys), "pos long, re double, im double"])
    return by_groups(df.select(*keys, "pos", "re", "im"), keys, 4 * max(n, m), run, schema)


def factors(n: int) -> tuple[int, int] | None:
    """n as a product of two numbers as equal as can be; None if they are too uneven."""
    a = next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)
    return (a, n // a) if n // a <= UNEVEN * a else None


def dft(df: DataFrame, others: list[str], axis: str, n: int, sign: int) -> DataFrame:
    """sum over j of x[j] exp(sign 2 pi i j k / n) along an axis."""
    place = F.col(axis)
    plain = np.fft.fft if sign < 0 else lambda z: np.fft.ifft(z) * z.shape[-1]
    if n <= LINE:
        rows = df.select(*others, F.lit(0).cast("long").alias("line"), place.alias("pos"), "re", "im")
        return by_lines(rows, others, n, n, lambda z, _: plain(z)).select(*others, F.col("pos").alias(axis), "re", "im")
    if not (pair := factors(n)):
        # Squares modulo 2 n keep the angle exact.
        return chirp(df, others, axis, n, n, lambda t: F.lit(sign * math.pi / n) * F.pmod(t * t, F.lit(2 * n)))
    a, b = pair
    rows = df.select(*others, (place % b).alias("line"), F.floor(place / b).alias("pos"), "re", "im")
    first = by_lines(rows, others, a, a, lambda z, line: plain(z) * np.exp(sign * 2j * np.pi / n * (line[:, None] * np.arange(a) % n)))
    rows = first.select(*others, F.col("pos").alias("line"), F.col("line").alias("pos"), "re", "im")
    second = by_lines(rows, others, b, b, lambda z, _: plain(z))
    return second.select(*others, (F.col("line") + a * F.col("pos")).alias(axis), "re", "im")


def chirp(df: DataFrame, others: list[str], axis: str, n: int, m: int, phase) -> DataFrame:
    """sum over j < n of x[j] exp(i (phase(j) + phase(k) - phase(k - j))), k < m, for an even function of whole numbers."""
    size, k = 1 << (n + m - 2).bit_length(), F.col("id")
    spectrum = dft(turned(df, phase(F.col(axis))), others, axis, size, -1)
    t = F.when(k < m, k).otherwise(k - size)
    kernel = df.sparkSession.range(size).where((k < m) | (k > size - n)).select(F.lit(0).cast("long").alias("s"), k.alias(axis), F.cos(phase(t)).alias("re"), (-F.sin(phase(t))).alias("im"))
    kernel = dft(kernel, ["s"], axis, size, -1).select(axis, F.col("re").alias("a"), F.col("im").alias("b"))
    re, im, a, b = (F.col(c) for c in ("re", "im", "a", "b"))
    both = spectrum.join(kernel, axis).select(*others, axis, ((re * a - im * b) / size).alias("re"), ((re * b + im * a) / size).alias("im"))
    return turned(dft(both, others, axis, size, 1).where(F.col(axis) < m), phase(F.col(axis)))


class FFT(Op):
    """The unnormalised transform over some axes of a core (*dim, 2); the adjoint is the unnormalised inverse."""

    def __init__(self, dim, axes=None):
        dim = as_shape(dim)
        self.axes = as_axes(axes, len(dim))
        super().__init__((*dim, 2), (*dim, 2), NORMAL)
        self.n = math.prod(dim[a] for a in self.axes)
        self.lipschitz = math.sqrt(self.n)

    def _along(self, x: Grid, sign: int) -> Grid:
        df, keys = waves(x), x.keys[:-1]
        for a in self.axes:
            df = dft(df, [k for k in keys if k != f"i{a}"], f"i{a}", self.dim[a], sign)
        return from_waves(df, self.dim)

    def apply(self, x):
        return self._along(x, -1)

    def adjoint(self, y):
        return self._along(y, 1)

    def gram(self):
        from fluxgrid.operators.linop import Homothety

        return Homothety(self.dim, float(self.n))

    def cogram(self):
        return self.gram()

    def pinv(self, y, damp=0.0, **fit):
        return self.adjoint(y).scale(1 / (self.n + damp))


def dft_by_join(x: Grid, axis: int = 0) -> Grid:
    """The transform of a real core along a short axis, by a join with its twiddle factors: (*dim, 2)."""
    n, name = x.shape[axis], f"i{axis}"
    angle = F.lit(2 * math.pi / n) * F.pmod(F.col("k") * F.col(name), F.lit(n))
    twiddles = x.spark.range(n * n).select(F.floor(F.col("id") / n).alias("k"), (F.col("id") % n).alias(name)).select("k", name, F.cos(angle).alias("re"), (-F.sin(angle)).alias("im"))
    others = [c for c in x.keys if c != name]
    both = x.df.join(F.broadcast(twiddles) if n <= 512 else twiddles, name).groupBy(*others, "k").agg(F.sum(F.col("v") * F.col("re")).alias("re"), F.sum(F.col("v") * F.col("im")).alias("im"))
    rows = both.withColumnRenamed("k", name).select(*x.keys, F.posexplode(F.array("re", "im")).alias("c", "v"))
    return Grid(rows.select(*x.keys, F.col("c").cast("long").alias(f"i{x.rank}"), "v"), (*x.shape, 2))


def chirp_z(z: np.ndarray, m: int, a: complex, w: complex) -> np.ndarray:
    """sum_n z[n] a^-n w^(n k) for k < m along the last axis, as one convolution (Bluestein)."""
    n = z.shape[-1]
    k = np.arange(max(n, m))
    chirp = w ** (k**2 / 2.0)
    size = 1 << (n + m - 2).bit_length() if n + m > 2 else 1
    x = np.fft.fft(z * a ** -np.arange(n) * chirp[:n], size)
    h = np.zeros(size, complex)
    h[:m] = 1 / chirp[:m]
    if n > 1:
        h[size - n + 1 :] = 1 / chirp[1:n][::-1]
    return np.fft.ifft(x * np.fft.fft(h))[..., :m] * chirp[:m]


class CZT(Op):
    """m[k] points from a[k] with ratio w[k] (both of modulus 1) along each of `axes` of a core (*dim, 2)."""

    def __init__(self, dim, axes, m, a, w):
        dim = as_shape(dim)
        self.axes = as_axes(axes, len(dim))
        self.m, self.a, self.w = ([v] * len(self.axes) if np.isscalar(v) else list(v) for v in (m, a, w))
        if any(not math.isclose(abs(z), 1, abs_tol=1e-9) for z in (*self.a, *self.w)):
            raise ValueError("a and w have modulus 1")
        codim = list(dim)
        for ax, k in zip(self.axes, self.m, strict=True):
            codim[ax] = int(k)
        super().__init__((*dim, 2), (*codim, 2), LINEAR)
        self.lipschitz = math.sqrt(math.prod(dim[ax] * k for ax, k in zip(self.axes, self.m, strict=True)))

    def _run(self, x: Grid, sizes, back: bool) -> Grid:
        df, keys, shape = waves(x), x.keys[:-1], list(x.shape)
        for ax, m, a, w in zip(self.axes, sizes, self.a, self.w, strict=True):
            n, m, axis = shape[ax], int(m), f"i{ax}"
            others = [k for k in keys if k != axis]
            # conj(A) has entries a^n w^(-nk): the same transform of the conjugates, turned by a.
            a, w = complex(a), np.conj(complex(w)) if back else complex(w)
            if max(n, m) <= LINE:
                rows = df.select(*others, F.lit(0).cast("long").alias("line"), F.col(axis).alias("pos"), "re", "im")
                fn = (lambda z, _, m=m, a=a, w=w: chirp_z(z, m, 1.0, w) * a ** np.arange(m)) if back else (lambda z, _, m=m, a=a, w=w: chirp_z(z, m, a, w))
                df = by_lines(rows, others, n, m, fn).select(*others, F.col("pos").alias(axis), "re", "im")
            else:
                turn, half = F.lit(float(np.angle(a))) * F.col(axis), float(np.angle(w)) / 2
                df = chirp(df if back else turned(df, -turn), others, axis, n, m, lambda t, half=half: F.lit(half) * (t * t))
                df = turned(df, turn) if back else df
            shape[ax] = m
        return from_waves(df, shape)

    def apply(self, x):
        return self._run(x, self.m, False)

    def adjoint(self, y):
        return self._run(y, [self.dim[ax] for ax in self.axes], True)


class FFTCorrelate(Stencil):
    """Stencil by transforms of tiles (overlap-save): for wide kernels."""

    weigh = staticmethod(weigh_by_transform)


class FFTConvolve(FFTCorrelate, Convolve):
    """Convolve by transforms."""

    sign = -1
