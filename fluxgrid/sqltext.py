"""SQL texts of signals, stencils and recursions: the plain forms that queries are checked against."""

from __future__ import annotations

from itertools import product
from math import exp, prod

SIGNALS = {
    "daily": """daily as (select g.i0, coalesce(d.v, 0.0)::double v from (select unnest(generate_series(0, 2498)) i0) g left join
        (select date_diff('day', date '1995-01-02', cast(l_shipdate as date)) i0, sum(l_quantity) v from lineitem group by 1) d using (i0))""",
    "heat": """heat as (select a.i0, b.i1, coalesce(e.v, 0)::double v from (select unnest(generate_series(0, 29)) i0) a
        cross join (select unnest(generate_series(0, 23)) i1) b left join
        (select date_diff('day', date '2024-01-01', cast(ts as date)) i0, extract(hour from ts) i1, sum(round(value * 100)::bigint)::bigint v
         from events group by 1, 2) e on e.i0 = a.i0 and e.i1 = b.i1)""",
    "vec": "vec as (select vec_id s, unnest(generate_series(0, 63)) i0, unnest(embedding)::double v from embeddings)",
    "tile": "tile as (select vec_id s, p // 8 i0, p % 8 i1, v from (select vec_id, unnest(generate_series(0, 63)) p, unnest(embedding)::double v from embeddings))",
    "mat": "mat as (select l_suppkey r, l_linenumber - 1 c, sum(l_quantity)::double w from lineitem group by 1, 2)",
    "unit": "unit as (select unnest(generate_series(0, 6)) c, unnest([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])::double v)",
}
SHAPES = {"daily": (2499,), "heat": (30, 24), "vec": (64,), "tile": (8, 8)}


def axes(signal: str) -> list[str]:
    return [f"i{k}" for k in range(len(SHAPES[signal]))]


def keys(signal: str) -> list[str]:
    return (["s"] if signal in ("vec", "tile") else []) + axes(signal)


def with_(signals: str, *more: str) -> str:
    return "with " + ",\n".join([*(SIGNALS[s] for s in signals.split()), *more]) + "\n"


def rounded(e: str) -> str:
    return f"round(({e})::double, 6) + 0.0 as v"


def each(signal: str, e: str) -> str:
    """An expression of v, place by place."""
    return with_(signal) + f"select {', '.join(f'{k}::bigint as {k}' for k in keys(signal))}, {rounded(e)} from {signal}"


def by_item(signal: str, e: str, of: str | None = None) -> str:
    """An aggregate of each item."""
    return with_(signal) + f"select s::bigint as s, {rounded(e)} from {of or signal} group by s"


def source(i: str, n: int, mode: str) -> str:
    """The place whose value shows at place i (any integer)."""
    return {"constant": i, "wrap": f"((({i}) % {n}) + {n}) % {n}", "edge": f"greatest(0, least({n - 1}, {i}))", "reflect": f"case when {i} < 0 then -({i}) when {i} >= {n} then {2 * (n - 1)} - ({i}) else {i} end", "symmetric": f"case when {i} < 0 then -({i}) - 1 when {i} >= {n} then {2 * n - 1} - ({i}) else {i} end"}[mode]


Taps = dict[tuple[int, ...], float]


def outer(*kernels: dict[int, float]) -> Taps:
    """Taps of a separable kernel."""
    return {tuple(o for o, _ in c): prod(w for _, w in c) for c in product(*(k.items() for k in kernels))}


def mix(*parts: tuple[float, Taps]) -> Taps:
    out: Taps = {}
    for a, taps in parts:
        for d, w in taps.items():
            out[d] = out.get(d, 0.0) + a * w
    return out


def bell(sigma: float, truncate: float = 3.0) -> dict[int, float]:
    r = int(truncate * sigma + 0.5)
    w = {k: exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)}
    return {k: v / sum(w.values()) for k, v in w.items()}


def bell_slope(sigma: float, truncate: float = 3.0) -> dict[int, float]:
    """Correlation weights of the first derivative of a Gaussian."""
    return {k: v * k / sigma**2 for k, v in bell(sigma, truncate).items()}


def bell_bend(sigma: float, truncate: float = 3.0) -> dict[int, float]:
    return {k: v * (k * k / sigma**4 - 1 / sigma**2) for k, v in bell(sigma, truncate).items()}


ONE, FORWARD, CENTRAL, SECOND = {0: 1.0}, {0: -1.0, 1: 1.0}, {-1: -0.5, 1: 0.5}, {-1: 1.0, 0: -2.0, 1: 1.0}


def table_of(name: str, taps: Taps) -> str:
    rank = len(next(iter(taps)))
    rows = ", ".join(f"({', '.join(map(str, d))}, {w!r}::double)" for d, w in taps.items() if w)
    return f"{name}({', '.join(f'd{k}' for k in range(rank))}, w) as (values {rows})"


def correlate(signal: str, taps: Taps, mode="constant", of: str | None = None, back: bool = False, shape=None) -> str:
    """A subquery: at each place the weighted sum of what its taps read; back: the adjoint."""
    shape, x = shape or SHAPES[signal], of or signal
    modes = [mode] * len(shape) if isinstance(mode, str) else mode
    item, rank = ("s, " if signal in ("vec", "tile") else ""), range(len(shape))
    at = [source(f"(x.i{k} + t.d{k})" if back else f"(g.i{k} + t.d{k})", n, m) for k, (n, m) in enumerate(zip(shape, modes, strict=True))]
    rows = ", ".join(f"({', '.join(map(str, d))}, {w!r}::double)" for d, w in taps.items() if w)
    t = f"(values {rows}) t({', '.join(f'd{k}' for k in rank)}, w)"
    names = ", ".join(f"i{k}" for k in rank)
    if back:
        inside = " and ".join(f"{a} between 0 and {n - 1}" for a, n in zip(at, shape, strict=True))
        inner = f"select {item}{', '.join(f'{a} as j{k}' for k, a in enumerate(at))}, t.w * x.v as p from {x} x cross join {t} where {inside}"
        return f"(select {item}{', '.join(f'j{k} as i{k}' for k in rank)}, sum(p) as v from ({inner}) group by all)"
    on = " and ".join([*(f"x.i{k} = {a}" for k, a in enumerate(at)), *(["x.s = g.s"] if item else [])])
    return f"(select {'g.s, ' if item else ''}{', '.join(f'g.i{k}' for k in rank)}, sum(t.w * x.v) as v from {x} g cross join {t} join {x} x on {on} group by {'g.s, ' if item else ''}{', '.join(f'g.i{k}' for k in rank)})" if names else ""


def filled(signal: str, sub: str, e: str = "coalesce(c.v, 0.0)") -> str:
    """The subquery on every place of the signal."""
    ks = keys(signal)
    return with_(signal) + f"select {', '.join(f'x.{k}::bigint as {k}' for k in ks)}, {rounded(e)} from {signal} x left join {sub} c using ({', '.join(ks)})"


def stacked(signal: str, subs: list[str]) -> str:
    """Subqueries on a new first axis k0."""
    ks = keys(signal)
    parts = [f"select {k}::bigint as k0, {', '.join(f'x.{c}::bigint as {c}' for c in ks)}, {rounded('coalesce(c.v, 0.0)')} from {signal} x left join {sub} c using ({', '.join(ks)})" for k, sub in enumerate(subs)]
    return with_(signal) + " union all ".join(parts)


def recursion(signal: str, start: dict[str, str], steps: int, columns: list[dict[str, str]], result: str) -> str:
    """Column-wise recursions: each step is a list of assignments that see the ones before."""
    ks, names = ", ".join(keys(signal)), list(start)
    ctes = [f"st0 as (select {ks}, v as y, {', '.join(f'({e})::double as {n}' for n, e in start.items())} from {signal})"]
    last, k = "st0", 0
    for _ in range(steps):
        for stage in columns:
            k += 1
            keep = ", ".join(f"({stage.get(n, n)})::double as {n}" for n in [*names, *(c for c in stage if c not in names)])
            names += [c for c in stage if c not in names]
            ctes.append(f"st{k} as (select {ks}, y, {keep} from {last})")
            last = f"st{k}"
    return with_(signal, *ctes) + f"select {', '.join(f'{c}::bigint as {c}' for c in keys(signal))}, {rounded(result)} from {last}"


def soft(e: str, t: str) -> str:
    return f"(sign({e}) * greatest(abs({e}) - ({t}), 0.0))"
