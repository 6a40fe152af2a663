"""Suffix-array dedup: removes bytes covered by a string of `span` bytes that also starts earlier in the corpus.

A sparse suffix array is enough. A window of `span` bytes is represented by the place of its smallest 32-byte hash (all
of them, if several are equal); two equal windows choose equal places, so it is enough to compare suffixes that begin
there, each with the bytes before it that a window can reach. First the hashes of these places are dealt and sorted:
only suffixes whose first 32 bytes begin another suffix too go on. Then the common-prefix-aware merge sort:

  runs      each task sorts suffixes (cut to `span` bytes), drops those whose whole reach is that of an earlier one in the
            run (their reach is covered), and front-codes the rest: length of the prefix shared with the one before, tail.
  exchange  runs are cut by the hash of the first 32 bytes into buckets of bounded size and dealt.
  merge     a loser tree combines the runs of a bucket. Every entry carries its common prefix with the last winner; two
            entries are compared from there on, and not at all where the prefixes differ in length.
  match     neighbours that share 32 bytes or more form a group; windows of a group that an earlier member also has are
            found from common prefixes and suffixes, in large groups from hashes of its windows.

Texts are UTF-8 bytes, null is empty, matches never cross documents; earlier is (doc_id, row, start), null doc_ids first,
as -2^63, which therefore comes back as null. A very long text is hashed whole by one worker, in memory that is a fixed
multiple of its bytes.
Rows are told apart by their place in the scan, so repeated rows are documents of their own (the later is removed) and
`docs` must be a table read from files. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.common import BROADCAST_IDS, Workspace, text_of
from fluxgrid.llm.shingles import mix, text_blocks

SPAN, GRAM = 100, 32
#: Suffixes in a run and, about, in a bucket.
RUN, BUCKET = 200_000, 40_000
NO_ID = -(1 << 63)
KNOWN, STANDS = 2, 1

_R = np.random.Generator(np.random.PCG64(771))
_BYTE = _R.integers(0, 1 << 64, 256, "u8")
_ODD = _R.integers(0, 1 << 63, 8, "u8") * np.uint64(2) + np.uint64(1)


def _powers(n: int, base: int) -> np.ndarray:
    return np.array([pow(base, k, 1 << 64) for k in range(n)], "u8")


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place; shorter by GRAM - 1."""
    h, width, k = _BYTE[data], 1, 0
    while width < GRAM:
        h = h[:-width] * _ODD[k] + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width, k = 2 * width, k + 1
    return mix(h)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of every `width` neighbours."""
    done = 1
    while 2 * done <= width:
        x, done = best(x[:-done], x[done:]), 2 * done
    return best(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Places chosen by some window of one text, and the hashes there."""
    width = span - GRAM + 1
    if len(data) < span:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    h = gram_hashes(data)
    low = _slide(h, width, np.minimum)  # of the window that starts at each place
    whole = np.zeros(len(low), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= span:
            whole[a : b - span + 1] = True
    low[~whole] = 0
    edge = np.zeros(width - 1, "u8")
    most = _slide(np.concatenate([edge, low, edge]), width, np.maximum)
    at = np.flatnonzero((most == h) & (most > 0))
    return at, h[at]


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be `start` at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(prefix lengths, lengths, tails) of sorted suffixes of at most 255 bytes."""
    shared, last = [], b""
    for s in suffixes:
        shared.append(common(last, s))
        last = s
    return bytes(shared), bytes(map(len, suffixes)), b"".join([s[k:] for s, k in zip(suffixes, shared, strict=True)])


def front_decode(shared: bytes, sizes: bytes, tails: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for k, n in zip(shared, sizes, strict=True):
        last = last[:k] + tails[at : at + n - k]
        at += n - k
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], bytes]]) -> Iterator[tuple[int, int, int]]:
    """(run, place, prefix shared with the entry before) of front-coded sorted runs, in order, by a loser tree.

    lcp[r] is the prefix that the head of run r shares with the last winner. Of two heads, the one with more of it comes
    first, unseen; if both have equally much, they are compared from there, and the loser remembers where they part.
    """
    k = len(runs)
    if k == 1:
        yield from ((0, i, s) for i, s in enumerate(runs[0][1]))
        return
    at, lcp, ends = [0] * k, [0] * k, [len(r[0]) for r in runs]
    head = [r[0][0] if r[0] else None for r in runs]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        n = common(x, y, lcp[a])
        first = len(x) == n or (len(y) != n and x[n] < y[n]) if x != y else a < b
        won, lost = (a, b) if first else (b, a)
        lcp[lost] = n
        return won, lost

    tree = [-1] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, tree[node] = play(build(2 * node), build(2 * node + 1))
        return won

    best = build(1)
    while head[best] is not None:
        i = at[best]
        yield best, i, lcp[best]
        at[best] = i = i + 1
        if i < ends[best]:
            head[best], lcp[best] = runs[best][0][i], runs[best][1][i]
        else:
            head[best] = None
        node = (best + k) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2


class Matcher:
    """Finds in a group of suffixes, sorted by age, the windows that an earlier member has."""

    def __init__(self, span: int):
        self.span, self.back = span, span - GRAM
        base = int(_ODD[6])
        self.pow, self.inv = _powers(self.back + span, base), _powers(self.back + 1, pow(base, -1, 1 << 64))

    def few(self, left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(member, bytes before, bytes after) that are covered."""
        turned = [x[::-1] for x in left]
        for j in range(1, len(right)):
            before = after = 0
            for i in range(j):
                r = common(right[i], right[j])
                if r + len(turned[j]) >= self.span:
                    b = common(turned[i], turned[j])
                    if r + b >= self.span:
                        before, after = max(before, b), max(after, r)
            if after:
                yield j, before, after

    def many(self, left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, int, int]]:
        g, w = len(right), self.back + self.span
        rows = b"".join([x.rjust(self.back, b"\0") + y.ljust(self.span, b"\0") for x, y in zip(left, right, strict=True)])
        sums = np.zeros((g, w + 1), "u8")
        np.cumsum(_BYTE[np.frombuffer(rows, "u1").reshape(g, w)] * self.pow, axis=1, out=sums[:, 1:])
        nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
        before, after = np.full(g, -1), np.zeros(g, int)
        for d in range(self.back + 1):
            ok = np.flatnonzero((nl >= d) & (nr >= self.span - d))
            start = self.back - d
            h = (sums[ok, start + self.span] - sums[ok, start]) * self.inv[start]
            again = np.ones(len(ok), bool)
            again[np.unique(h, return_index=True)[1]] = False
            hit = ok[again]
            before[hit] = d
            after[hit] = np.maximum(after[hit], self.span - d)
        for j in np.flatnonzero(before >= 0).tolist():
            yield j, int(before[j]), int(after[j])


def _join(big: DataFrame, small: DataFrame, key: str, count: int) -> DataFrame:
    """Only the texts that `small` names are shuffled, while its keys are few enough to broadcast."""
    if count <= BROADCAST_IDS:
        big = big.join(F.broadcast(small.select(key)), key, "left_semi")
    return big.join(small.hint("merge"), key)


def suffix_dedup(docs: DataFrame, span: int = SPAN, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; texts: also the kept bytes."""
    if not GRAM < span <= 255:
        raise ValueError(f"span must be over {GRAM} and at most 255")
    spark, back = docs.sparkSession, span - GRAM
    work = Workspace(spark, "suffix-dedup")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of(docs).alias("text"))

    def places(batches):
        """key, row, place and mark. Places whose key recurs in a batch are known to go on (mark KNOWN); one of them stands
        for the key in the exchange (mark STANDS), so a key that is everywhere comes once from each batch."""
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, data, offsets in text_blocks(batch.column(1)):
                at, h = anchors(data, offsets, span)
                doc = np.searchsorted(offsets, at, "right") - 1
                _, one, back, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                again = times[back] > 1
                stands = one[times > 1]
                pick = np.concatenate([np.arange(len(h)), stands])
                mark = np.concatenate([np.where(again, KNOWN, 0), np.full(len(stands), STANDS)]).astype("i4")
                yield pa.RecordBatch.from_arrays([pa.array(h[pick].astype("i8")), pa.array(ids[first + doc[pick]]), pa.array((at - offsets[doc])[pick].astype("i4")), pa.array(mark)], names=["key", "row", "at", "mark"])

    def shared(batches):
        """(row, place) of the places that go on; rows come sorted by key, those known in between."""
        last, held = None, None
        for batch in batches:
            k, r, p, m = (batch.column(i).to_numpy() for i in range(4))
            known = m == KNOWN
            r_out, p_out = [r[known]], [p[known]]
            k, r, p, m = (x[~known] for x in (k, r, p, m))
            if len(k):
                same = np.concatenate([[last is not None and k[0] == last], k[1:] == k[:-1]])
                met_ = same | np.concatenate([same[1:], [False]])
                out = met_ & (m != STANDS)
                r_out.append(r[out])
                p_out.append(p[out])
                if same[0] and held is not None:
                    r_out.append(np.array([held[0]]))
                    p_out.append(np.array([held[1]]))
                held = None if met_[-1] or m[-1] == STANDS else (r[-1], p[-1])
                last = k[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r_out).astype("i8")), pa.array(np.concatenate(p_out).astype("i4"))], names=["row", "at"])

    spread = F.when(F.col("mark") == KNOWN, F.xxhash64("row", "at")).otherwise(F.col("key"))
    met = rows.select("row", "text").mapInArrow(places, "key long, row long, at int, mark int").repartition(spread).sortWithinPartitions("key").mapInArrow(shared, "row long, at int")
    met = work.write(met.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("at")), "places")
    n_rows, n_places = met.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    buckets = max(64, n_places // BUCKET)

    def runs(batches):
        held: list[tuple[bytes, bytes, int, int, int]] = []

        def emit():
            held.sort()
            by_bucket: dict[int, list] = {}
            covered, last = [], (None, None)
            for e in held:
                if e[:2] == last:
                    if len(e[0]) + len(e[1]) >= span:
                        covered.append((e[3], e[4] - len(e[1]), e[4] + len(e[0])))
                else:
                    last = e[:2]
                    by_bucket.setdefault(zlib.crc32(e[0][:GRAM]) % buckets, []).append(e)
            held.clear()
            names, blobs = [], []
            for name, es in by_bucket.items():
                right, left, doc, row, at = zip(*es, strict=True)
                ids = np.array([doc, row, at], "<i8").T.tobytes()
                names.append(name)
                blobs.append((*front_code(list(right)), bytes(map(len, left)), b"".join(left), ids))
            ends = np.array(covered, "<i8").reshape(-1, 3)
            names.append(-1)
            blobs.append((b"", b"", b"", b"", b"", ends.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array([b[i] for b in blobs], pa.binary()) for i in range(6))], names=["bucket", "shared", "sizes", "tails", "before_sizes", "before", "ids"])

        for batch in batches:
            r, d, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for i, text in enumerate(batch.column(2)):
                raw = text.as_py().encode()
                for p in at[i].values.to_numpy().tolist():
                    held.append((raw[p : p + span], raw[max(0, p - back) : p], d[i], r[i], p))
                if len(held) >= RUN:
                    yield emit()
        yield emit()

    def merge(batches):
        matcher = Matcher(span)

        def settle(right, left, ids):
            order = np.lexsort(ids.T[::-1])
            right, left = [right[i] for i in order], [left[i] for i in order]
            for j, before, after in (matcher.few if len(order) <= 6 else matcher.many)(left, right):
                _, row, at = ids[order[j]].tolist()
                yield row, at - before, at + after

        def combine(parts):
            out, group, decoded = [], [], []
            for shared_, sizes, tails, before_sizes, before, ids in parts:
                cut = np.concatenate([[0], np.cumsum(np.frombuffer(before_sizes, "u1"), dtype="i8")]).tolist()
                left = [before[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                decoded.append((front_decode(shared_, sizes, tails), shared_, left, np.frombuffer(ids, "<i8").reshape(-1, 3)))

            def close():
                if len(group) > 1:
                    right, left, ids = zip(*[(decoded[r][0][i], decoded[r][2][i], decoded[r][3][i]) for r, i in group], strict=True)
                    out.extend(settle(list(right), list(left), np.stack(ids)))

            for r, i, lcp in merge_runs([d[:2] for d in decoded]):
                if lcp < GRAM:
                    close()
                    group = []
                group.append((r, i))
            close()
            return out

        def spans(found):
            x = np.array(found, "i8").reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].astype("i4")), pa.array(x[:, 2].astype("i4"))], names=["row", "start", "stop"])

        bucket, parts = None, []
        for batch in batches:
            found = []
            for b, *part in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if b < 0:
                    found.extend(np.frombuffer(part[-1], "<i8").reshape(-1, 3).tolist())
                    continue
                if b != bucket:
                    found.extend(combine(parts) if parts else [])
                    bucket, parts = b, []
                parts.append(part)
            yield spans(found)
        if parts:
            yield spans(combine(parts))

    blob = "bucket int, shared binary, sizes binary, tails binary, before_sizes binary, before binary, ids binary"
    fragments = _join(rows, met, "row", n_rows).select("row", "doc_id", "text", "at").mapInArrow(runs, blob)
    spread = F.when(F.col("bucket") < 0, F.monotonically_increasing_id()).otherwise(F.col("bucket"))
    spans = fragments.repartition(spread).sortWithinPartitions("bucket").mapInArrow(merge, "row long, start int, stop int")
    spans = work.write(spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")), "spans")
    work.drop("places")
    n_hit = spans.count()

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1)):
                raw, kept, at, removed, runs_ = text.as_py().encode(), [], 0, 0, 0
                found = batch.column(2)[i].values
                for a, b in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                    if a > at or not runs_:
                        kept.append(raw[at:a])
                        runs_ += 1
                        removed += b - a
                        at = b
                    elif b > at:
                        removed += b - at
                        at = b
                kept.append(raw[at:])
                rest = b"".join(kept)
                for to, x in zip(out, (len(raw), removed, runs_, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)][: 5 if texts else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols) + 1])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    changed = _join(rows, spans, "row", n_hit).select("doc_id", "text", "spans").mapInArrow(cut, schema)
    rest = rows.join(F.broadcast(spans.select("row")) if n_hit <= BROADCAST_IDS else spans.select("row").hint("merge"), "row", "left_anti")
    zero = F.lit(0).cast("long")
    raw = F.col("text").cast("binary")
    rest = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), *([raw.alias("kept")] if texts else []))
    both = changed.unionByName(rest)
    return both.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
