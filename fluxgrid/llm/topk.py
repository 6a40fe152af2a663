"""The candidates with the largest inner products, for every query, without random access to the vectors.

Components count as floor(scale * x), so that scores are whole numbers. A query is a row whose vec_id is divisible by
`every`; its candidates are all other rows.

No-random-access aggregation, tile by tile. Each task of the first pass makes tiles of up to TILE vectors. A tile keeps,
for each component, the list of its vectors sorted by value; a query reads a list from the top where its own component
is positive, from the bottom where it is negative, so that contributions come in descending order. All lists are read to
the same depth. What has been read gives each vector's partial score; the last entries read bound what a vector
can still get from lists in which it was not seen (upper score), the lists' far ends what it must at least get (lower
score). The vectors of which the upper score is below the k-th largest lower score so far are out: outsiders. While a
vector that was seen nowhere could still qualify, bounds aren't even looked at; reading goes on in steps until one vector
in CONTENDERS at most is left in, or the lists are at their ends, and only of those the scores are resolved.

A query meets its own tile first; the k-th score found there is the lower bound with which it enters all other tiles.
Tiles and queries meet in groups of one tile and a band of queries, so that a task's memory depends on neither count.
Each group hands on k rows a query at most; they are ranked once more at the end.

Vectors that are null, empty or hold null or non-finite components take no part. A vector that is shorter than another
counts as 0 beyond its end. Repeated rows, and rows with equal vec_id, are rows of their own, so a row's copies are among
its candidates; a query listed twice has its list twice. A null vec_id is no query, but a candidate, ranked after all
others of its score. Scores beyond the range of a long count as the nearest long. Other columns are not read. Without
queries, and for an empty table, there are no rows. Sums that could leave the exact range of floating point are
made with Python's whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.llm.common import Workspace, tidy

#: Vectors of a tile, and queries that meet a tile together.
TILE, BAND = 16_384, 8_192
#: Queries of which the bounds are held at once.
CHUNK = 256
#: Reading ends where one in so many vectors is still in; a list is read in steps of one in STEPS of its length.
CONTENDERS, STEPS = 8, 8
_LONG = (1 << 63) - 1
_BLOCK = "part int, k int, n int, width int, ids binary, known binary, vectors binary"
_FOUND = "query_row long, query_id long, vec_id long, score long"
#: The queries of a tile with the scores they found there, and what they found.
_ASKED = "part int, k int, n int, width int, places binary, ids binary, vectors binary, floors binary, query_row array<long>, query_id array<long>, vec_id array<long>, score array<long>"


class Lists:
    """The sorted lists of a tile."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype("f8")
        self.sorted = np.sort(x, axis=0).astype("f8")
        self.place = np.empty(x.shape, "i4")
        order = np.argsort(x, axis=0, kind="stable")
        np.put_along_axis(self.place, order, np.arange(len(x), dtype="i4")[:, None], 0)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which entries lie in the first `depth` from the top and from the bottom, and the last values read there."""
        n = len(self.x)
        return (self.place >= n - depth).astype("f8"), (self.place < depth).astype("f8"), self.sorted[n - depth], self.sorted[depth - 1]


def _bounds(lists: Lists, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper scores of all vectors (rows) for all queries (columns), from the first entries of the lists. up, down:
    the queries' positive and negative components, else 0."""
    top, bottom, last_top, last_bottom = lists.read(depth)
    partial = (lists.x * top) @ up.T + (lists.x * bottom) @ down.T
    worst_up, worst_down = up * lists.sorted[0], down * lists.sorted[-1]
    next_up, next_down = up * last_top, down * last_bottom
    lower = partial + (worst_up + worst_down).sum(1) - top @ worst_up.T - bottom @ worst_down.T
    upper = partial + (next_up + next_down).sum(1) - top @ next_up.T - bottom @ next_down.T
    return lower, upper


def _unseen(lists: Lists, up: np.ndarray, down: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """The upper score, by depth and query, of a vector that no list has shown."""
    return lists.sorted[len(lists.x) - depths] @ up.T + lists.sorted[depths - 1] @ down.T


def contenders(lists: Lists, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, query) of the pairs that can be among the k largest scores of their query; own: the query's row in the tile, or
    -1, which is no candidate; floor: a score that k candidates elsewhere reach."""
    n = len(lists.x)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    depths = np.unique(np.maximum(1, np.arange(1, STEPS + 1) * n // STEPS))
    mine = np.flatnonzero(own >= 0)
    start = len(depths) // 2
    if np.isfinite(floor).all():
        qualify = (_unseen(lists, up, down, depths) >= floor).mean(1)
        start = min(len(depths) - 1, int(np.argmax(qualify < 0.5)) if (qualify < 0.5).any() else len(depths) - 1)
    for depth in depths[start:].tolist():
        lower, upper = _bounds(lists, up, down, depth)
        lower[own[mine], mine] = upper[own[mine], mine] = -np.inf
        least = np.maximum(floor, np.partition(lower, n - k, 0)[n - k]) if n >= k else floor
        left = (upper >= least) & (upper > -np.inf)
        if depth == n or left.sum() * CONTENDERS <= left.size:
            return np.nonzero(left)
    raise AssertionError("the lists have an end")


def _ranked(order: list[np.ndarray], query: np.ndarray, k: int) -> np.ndarray:
    """The first k of each query, by the columns of `order`."""
    at = np.lexsort((*order[::-1], query))
    q = query[at]
    first = np.searchsorted(q, q)
    return at[np.arange(len(q)) - first < k]


def best(x: np.ndarray, lists: Lists | None, ids: np.ndarray, known: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best of a tile for each query. Without lists, all scores in Python's numbers."""
    if lists is None:
        scores = np.array([[min(_LONG, max(-_LONG - 1, sum(a * b for a, b in zip(v, q, strict=True)))) for q in queries.tolist()] for v in x.tolist()], "i8").reshape(len(x), len(queries))
        vector, query = np.nonzero(np.arange(len(x))[:, None] != own[None, :])
        score = scores[vector, query]
    else:
        vector, query = contenders(lists, queries, own, floor, k)
        score = np.empty(len(vector), "i8")
        for a in range(0, len(vector), 100_000):
            b = slice(a, a + 100_000)
            score[b] = np.einsum("ij,ij->i", x[vector[b]].astype("i8"), queries[query[b]].astype("i8"))
    take = _ranked([-score.astype(object) if (score == -_LONG - 1).any() else -score, ~known[vector], ids[vector]], query, k)
    return query[take], vector[take], score[take]


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _exact(x: np.ndarray, queries: np.ndarray) -> bool:
    """Whether all sums stay in the exact range of floating point."""
    most = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (x, queries)]
    return most[0] * most[1] * x.shape[1] < 1 << 52


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Tile:
    """Vectors with their ids; known: whether the id is not null. Row k of tile (part, k) has the number base + k."""

    def __init__(self, r: dict):
        self.base = ((r["part"] << 20) + r["k"]) << 20
        self.ids, self.known = np.frombuffer(r["ids"], "i8"), np.frombuffer(r["known"], "?")
        self.x = np.frombuffer(r["vectors"], "i8").reshape(r["n"], r["width"])


def _found(tile: Tile, lists: Lists | None, x: np.ndarray, base: int, places: np.ndarray, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[dict]:
    """What queries find in a tile, CHUNK by CHUNK; base: of the tile that the queries are from, where they have `places`."""
    for a in range(0, len(queries), CHUNK):
        b = slice(a, a + CHUNK)
        own = places[b] if base == tile.base else np.full(len(places[b]), -1)
        query, vector, score = best(x, lists, tile.ids, tile.known, queries[b], own, floors[b], k)
        yield {"query": query + a, "query_row": base + places[b][query], "query_id": ids[b][query], "vec_id": pa.array(tile.ids[vector], mask=~tile.known[vector]), "score": score}


def _pack(part: int, k: int, ids: pa.Array, vectors: pa.Array) -> pa.RecordBatch:
    lengths = np.diff(vectors.offsets.to_numpy())
    x = np.zeros((len(ids), int(lengths.max())), "i8")
    x[np.arange(x.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
    values = [[part], [k], [len(ids)], [x.shape[1]], *([v.tobytes()] for v in (ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), x))]
    kinds = [pa.int32()] * 4 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])


def _make_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of the rows of a task, numbered by its partition and from 0 in it."""
    from pyspark import TaskContext

    part, made, held = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        while len(held) >= TILE:
            tile, held = held.slice(0, TILE).combine_chunks(), held.slice(TILE)
            yield _pack(part, made, tile["id"].chunk(0), tile["v"].chunk(0))
            made += 1
    if held is not None and len(held):
        held = held.combine_chunks()
        yield _pack(part, made, held["id"].chunk(0), held["v"].chunk(0))


def _ask_own(every: int, k: int):
    """Each tile's queries meet the tile they are from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tile = Tile(r)
                places = np.flatnonzero(tile.known & (tile.ids % every == 0))
                for a in range(0, len(places), BAND):
                    at = places[a : a + BAND]
                    q, floors = tile.x[at], np.full(len(at), -np.inf)
                    found = list(_found(tile, Lists(tile.x) if _exact(tile.x, q) else None, tile.x, tile.base, at, tile.ids[at], q, floors, k))
                    rows = {c: np.concatenate([f[c] for f in found]) for c in ("query", "query_row", "query_id", "score")}
                    enough = np.bincount(rows["query"], minlength=len(at)) >= k
                    last = np.full(len(at), _LONG)
                    np.minimum.at(last, rows["query"], rows["score"])
                    floors[enough] = last[enough]
                    packed = [[r["part"]], [r["k"]], [len(at)], [q.shape[1]], *([v.tobytes()] for v in (at, tile.ids[at], q, floors))]
                    lists = [rows["query_row"], rows["query_id"], pa.concat_arrays([f["vec_id"] for f in found]), rows["score"]]
                    columns = [pa.array(v, t) for v, t in zip(packed, [pa.int32()] * 4 + [pa.binary()] * 4, strict=True)]
                    columns += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.int64())) for v in lists]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ASKED.split(", ")])

    return run


def _ask_others(k: int):
    """The queries of other tiles meet a tile."""

    def run(tiles: pa.Table, asked: pa.Table) -> pa.Table:
        out = [pa.table({c.split()[0]: pa.array([], pa.int64()) for c in _FOUND.split(", ")})]
        for r in tiles.to_pylist():
            tile = Tile(r)
            x = _widen(tile.x, max([tile.x.shape[1], *asked["width"].to_pylist()]))
            lists = Lists(x)
            for batch in asked.to_batches():
                for row in batch.to_pylist():
                    q = _widen(np.frombuffer(row["vectors"], "i8").reshape(row["n"], row["width"]), x.shape[1])
                    use = lists if _exact(x, q) else None
                    places, ids = np.frombuffer(row["places"], "i8"), np.frombuffer(row["ids"], "i8")
                    base = ((row["part"] << 20) + row["k"]) << 20
                    for f in _found(tile, use, x, base, places, ids, q, np.frombuffer(row["floors"], "f8"), k):
                        out.append(pa.table({c: pa.array(f[c], pa.int64()) for c in ("query_row", "query_id", "vec_id", "score")}))
        return pa.concat_tables(out)

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score)"""
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where(F.size("v") > 0)
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    bound = float(1 << 53)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x * scale))).cast("long"))
    slots = max(-(-vectors.count() // TILE), spark.sparkContext.defaultParallelism)
    tiles = work.write(rows.select("id", whole.alias("v")).coalesce(slots).mapInArrow(_make_tiles, _BLOCK), "tiles")
    asked = work.write(tiles.mapInArrow(tidy(_ask_own(every, k)), _ASKED), "asked")

    size = tiles.agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("parts"), F.coalesce(F.max("k") + 1, F.lit(0)).alias("each"), F.count(F.lit(1)).alias("tiles")).first()
    bands = -(-(asked.agg(F.sum("n")).first()[0] or 0) // BAND)
    found = asked.select(F.explode(F.arrays_zip("query_row", "query_id", "vec_id", "score")).alias("f")).select("f.*")
    if size["tiles"] > 1 and bands:
        # Each band of queries goes to each tile but its own, and each tile to each band.
        slot = F.col("part") * size["each"] + F.col("k")
        questions = asked.select("part", "k", "n", "width", "places", "ids", "vectors", "floors", F.pmod(F.xxhash64("part", "k", "places"), F.lit(bands)).alias("band"), slot.alias("home"))
        questions = questions.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size["parts"] * size["each"] - 1)))).where("slot <> home")
        copies = tiles.withColumn("slot", slot).withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands - 1).cast("long"))))
        met = copies.groupBy("slot", "band").cogroup(questions.groupBy("slot", "band")).applyInArrow(_ask_others(k), _FOUND)
        found = found.unionByName(met)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
