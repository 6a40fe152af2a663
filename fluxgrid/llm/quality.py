"""Quality classifier: a generalised additive model with pairwise interactions.

Training boosts shallow trees in turn over single features (and then over the pairs with the largest gain on what is
left), each tree being added to a lookup table over the feature's bins. A score is the logistic of a sum of table
entries, one for each feature and pair.

Training reads a bounded sample of labelled rows: at most `max_train` of them, those with the smallest hash of doc_id.
Rows whose crc32(doc_id as text) mod 5 is 0 never train. Everything else covers every row and every whole text; features
depend on the text alone. Null texts count as empty, and empty texts get a score as all others. A doc_id labelled more
than once takes its lowest label; null labels do not count. Without any usable label every score is 0.5. A null doc_id
is never held out. Repeated rows are scored once each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.common import text_of, tidy

MAX_TRAIN = 20_000
THRESHOLD = 0.3
FEATURES = ("chars", "words", "word_length", "letters", "upper", "digits", "marks", "symbols", "distinct_words", "top_word", "lines", "distinct_lines", "line_length", "ends")

_CLASS = np.zeros(256, "u1")  # 1: upper case, 2: letter, 3: digit, 4: . , ; : ' - ? (sentence marks), 5: other symbols
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123), *range(128, 256)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[*b".,;:'-?"]] = 4
_CLASS[[*b"!\"#$%&()*+/<=>@[\\]^_`{|}~"]] = 5


def features(text: str) -> tuple[float, ...]:
    raw = text.encode()
    kinds = np.bincount(_CLASS[np.frombuffer(raw, "u1")], minlength=6) if raw else np.zeros(6)
    words, lines = text.split(), text.split("\n")
    n, w, m = max(1, len(raw)), max(1, len(words)), len(lines)
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    letters = kinds[1] + kinds[2]
    return (
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / w, letters / n, kinds[1] / max(1, letters), kinds[3] / n, kinds[4] / n, kinds[5] / n,
        len(counts) / w, max(counts.values(), default=0) / w, float(np.log1p(m)), len(set(lines)) / m, float(np.log1p(len(text) / m)), sum(x[-1:] in ".!?" and x != "" for x in lines) / m,
    )


@dataclass
class Model:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    #: Bin of a feature -> coarser bin in the pair tables.
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            out += t[b[:, f]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Best-first cuts of the ordered bins into at most `leaves` runs; the value of each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        won = _gain(cg[k] - cg[a], ch[k] - ch[a], l2) + _gain(cg[b] - cg[k], ch[b] - ch[k], l2) - _gain(cg[b] - cg[a], ch[b] - ch[a], l2)
        return float(won.max()), int(k[won.argmax()])

    runs = [(0, len(g))]
    while len(runs) < leaves:
        (won, at), run = max((best(*r), r) for r in runs)
        if won <= 1e-9:
            break
        runs.remove(run)
        runs += [(run[0], at), (at, run[1])]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a table of bins: gain over no cut, and the value of each cell."""
    def corner(x: np.ndarray) -> np.ndarray:
        return np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    cg, ch = corner(g), corner(h)
    parts = [(c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1]) for c in (cg, ch)]
    if not parts[0][0].size:
        return 0.0, np.zeros_like(g)
    won = sum(_gain(a, b, l2) for a, b in zip(*parts, strict=True)) - _gain(cg[-1, -1], ch[-1, -1], l2)
    i, j = np.unravel_index(won.argmax(), won.shape)
    v = [float((a / (b + l2))[i, j]) for a, b in zip(*parts, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(won[i, j]), out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, pair_rounds: int = 40, n_pairs: int = 5, n_bins: int = 48, n_coarse: int = 8, rate: float = 0.15, l2: float = 2.0) -> Model:
    m = Model()
    if len(y) == 0:
        return m
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m.bias = float(np.log(base / (1 - base)))
    m.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(x.shape[1])]
    b = m.bins(x)
    sizes = [len(e) + 1 for e in m.edges]
    m.tables = [np.zeros(s) for s in sizes]
    z = np.full(len(y), m.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, s in enumerate(sizes):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, f], g, s), np.bincount(b[:, f], h, s), 3, l2)
            m.tables[f] += step
            z += step[b[:, f]]
    m.coarse = [np.minimum(np.arange(s) * n_coarse // s, n_coarse - 1) for s in sizes]

    def cells(i: int, j: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        g, h = slopes()
        at = m.coarse[i][b[:, i]] * n_coarse + m.coarse[j][b[:, j]]
        return at, tuple(np.bincount(at, v, n_coarse * n_coarse).reshape(n_coarse, n_coarse) for v in (g, h))

    ranked = sorted(((_quadrants(*cells(i, j)[1], l2)[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    m.pairs = [(i, j) for _, i, j in ranked[:n_pairs]]
    m.pair_tables = [np.zeros((n_coarse, n_coarse)) for _ in m.pairs]
    for _ in range(pair_rounds):
        for t, (i, j) in zip(m.pair_tables, m.pairs, strict=True):
            at, (g, h) = cells(i, j)
            step = rate * _quadrants(g, h, l2)[1]
            t += step
            z += step.ravel()[at]
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _rows_of_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.array(features(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Trains on at most max_train labelled rows outside the held-out fifth; the driver gets their features alone."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).dropna()
    chosen = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    # A bounded side: at most max_train rows of two numbers.
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_rows_of_features, "label int, x array<double>").orderBy(F.xxhash64("x"), "label").limit(2 * max_train).toPandas()
    return train(np.array(rows["x"].tolist()).reshape(-1, len(FEATURES)), rows["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype("i4"))], names=["doc_id", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    rows = score(docs, fit(docs, labels, label, max_train), threshold)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs, with their own columns, that are not rejected."""
    model = fit(docs, labels, "quality", max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
