"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased and split at white space and ASCII punctuation; signs of scripts without spaces (Han, kana, Thai)
are words of their own. A passage is aligned with an item word by word: match +2, mismatch -1, gap -1, best local score. A
pair is reported when the score reaches `threshold` of a full match, or when `run` words in a row are the same. Items of
fewer than `min_words` words count only as a whole, and those of one word or under `MIN_CHARS` characters are too short to
tell and match nothing.

Seeds: an alignment at the threshold keeps a share of an item's bigrams, whatever words were replaced or deleted, as long
as at most a quarter of the item's length was inserted (`least_kept`). So the commonest bigrams, as counted over all
documents, can be left out: of the others each such alignment holds one, or two where the item is long enough. Besides,
the rarest of each `stride` neighbours is a seed, so that each run of `run` words holds one. Documents are scanned for seeds;
hits of one item on neighbouring diagonals open a passage, which is aligned if it has enough seeds, and if its words could
reach the threshold in the best case. So what is left out never reaches it, but for copies with more words inserted.

The items are the stated query set; they are read in blocks of a bounded number of words (broadcast to the scan), each
against all documents. Documents are never shuffled; long texts are scanned whole, in one task each. Null texts are empty.
Repeated documents are reported once each, repeated items too; null ids stay null. Of several passages of a document the
best is reported, the first of equally good ones. Extra columns are not read. Without documents or items there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.common import text_of, tidy
from fluxgrid.llm.shingles import combine, text_blocks, words

GRAM, STRIDE, MIN_WORDS, MIN_CHARS, THRESHOLD, RUN = 2, 4, 5, 12, 0.5, 13
#: Scripts without spaces between words.
SIGNS = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])"
#: Characters of test items in a block: what is broadcast is about twice as much.
BLOCK_CHARS = 8_000_000
SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long, seeds int"


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score of two word sequences, and the first and last word of the passage that it covers."""
    n = len(passage)
    step = np.arange(n + 1)
    above, begun = np.zeros(n + 1, "i8"), step.copy()
    best = (0, 0, -1)
    for w in item:
        here, start = np.zeros(n + 1, "i8"), step.copy()
        diagonal = above[:-1] + np.where(passage == w, 2, -1)
        up = above[1:] - 1
        here[1:] = np.maximum(np.maximum(diagonal, up), 0)
        start[1:] = np.where(here[1:] == 0, step[1:], np.where(diagonal >= up, begun[:-1], begun[1:]))
        lead = here + step
        far = np.maximum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == far, step, 0))
        here, start = far - step, start[source]
        above, begun = here, start
        k = int(here.argmax())
        if here[k] > best[0]:
            best = (int(here[k]), int(start[k]), k - 1)
    return best


def longest_run(item: np.ndarray, passage: np.ndarray) -> int:
    """Words in a row that both hold."""
    above, best = np.zeros(len(passage) + 1, "i8"), 0
    for w in item:
        here = np.zeros(len(passage) + 1, "i8")
        here[1:] = np.where(passage == w, above[:-1] + 1, 0)
        above, best = here, max(best, int(here.max()))
    return best


def separated(column: pa.Array) -> pa.Array:
    """Lower-cased texts, with spaces around the signs of scripts without spaces."""
    column = pc.utf8_lower(column)
    if len(column) and column.buffers()[2]:
        data = np.frombuffer(column.buffers()[2], "u1")
        if ((data >= 0xE3) | (data == 0xE0)).any():  # the first bytes of such signs
            return pc.replace_substring_regex(column, SIGNS, r" \1 ")
    return column


def least_kept(n: int, threshold: float) -> int:
    """Bigrams of an item of n words that every alignment of the threshold keeps (1 if none need be), if at most n // 4 words
    are inserted. With m words matched in runs that b edits part, m - 1 - b bigrams are kept; b is at most 2 m - T, as each
    edit costs 1 of the score T, and at most n - m + n // 4, as the others take a word of the item."""
    need = int(np.ceil(2 * threshold * n - 1e-9))
    return max(1, min(m - 1 - min(2 * m - need, n - m + n // 4) for m in range(-(-need // 2), n + 1)))


class Items:
    """The bigrams of a block of test items."""

    def __init__(self, ids: list, texts: list[str], min_words: int, threshold: float, run: int):
        self.ids, self.words, self.need, self.run = [], [], [], run
        for first, data, offsets in text_blocks(separated(pa.array(texts, pa.string()))):
            w, _, _, at = words(data, offsets, bare=True)
            for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if b - a >= 2 and len(texts[first + i].strip()) >= (0 if b - a >= min_words else MIN_CHARS):
                    self.ids.append(ids[first + i])
                    self.words.append(w[a:b].copy())
                    self.need.append((threshold if b - a >= min_words else 1.0) * 2 * int(b - a))
        self.grams = [combine(w, GRAM) for w in self.words]
        self.all = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, "u8")

    def choose(self, counts: dict[int, int], stride: int) -> None:
        """Seeds, as three arrays by hash: hash, item and place; and how many of them a passage of each item needs."""
        found, needed = [], []
        for i, g in enumerate(self.grams):
            rare = np.array([counts.get(int(x), 0) for x in g.astype("i8")])
            kept = least_kept(len(g) + 1, self.need[i] / (2 * len(g) + 2))
            needed.append(min(2, kept))
            chosen = np.argsort(rare, kind="stable")[: len(g) - kept + needed[i]]
            if len(g) >= self.run - 1:
                chosen = np.union1d(chosen, [k + int(rare[k : k + stride].argmin()) for k in range(max(1, len(g) - stride + 1))])
            found.append(np.stack([g[chosen], np.full(len(chosen), i, "u8"), chosen.astype("u8")]))
        rows = np.concatenate(found, axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        self.hash, self.item, self.place = rows[0], rows[1].astype("i8"), rows[2].astype("i8")
        self.needed = np.array(needed)


class Lookup:
    """Which of many hashes are in a sorted set: a bit table first."""

    def __init__(self, known: np.ndarray):
        self.known, bits = known, max(16, int(np.log2(len(known) + 1)) + 5)
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(known & self.mask).astype("i8")] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[(h & self.mask).astype("i8")])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == h[maybe]]


def _hits(column: pa.Array, lookup: Lookup):
    """(first row, words, first word of each text, n-grams, text and place of each n-gram that is known)."""
    for row, data, offsets in text_blocks(separated(column)):
        w, _, _, first = words(data, offsets, bare=True)
        g = combine(w, GRAM)
        at = lookup.places(g)
        doc = np.searchsorted(first, at, "right") - 1
        inside = at + GRAM <= first[doc + 1]
        yield row, w, first, g, doc[inside], at[inside]


def _count(docs: DataFrame, items: Items) -> dict[int, int]:
    """Number of documents that hold each n-gram of the items; as many rows as the items have n-grams."""
    known = docs.sparkSession.sparkContext.broadcast(items.all)

    def run(batches):
        lookup = Lookup(known.value)
        for batch in batches:
            seen = [np.zeros((0, 2), "u8")]
            for _, _, _, g, doc, at in _hits(batch.column(1), lookup):
                seen.append(np.unique(np.stack([doc.astype("u8"), g[at]], 1), axis=0))
            h, n = np.unique(np.concatenate([s[:, 1] for s in seen]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype("i8")), pa.array(n.astype("i8"))], names=["gram", "n"])

    return {r["gram"]: r["n"] for r in docs.mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}


class Scanner:
    """Finds the items of a block in texts."""

    def __init__(self, items: Items):
        self.items, self.known = items, np.unique(items.hash)
        self.first = np.append(np.searchsorted(items.hash, self.known), len(items.hash))
        self.sizes, self.lookup = np.array([len(w) for w in items.words]), Lookup(self.known)
        self.sorted = [np.sort(w) for w in items.words]

    def passages(self, g: np.ndarray, doc: np.ndarray, place: np.ndarray):
        """(text, item, least and largest diagonal, seeds) of runs of hits on neighbouring diagonals with enough seeds."""
        known = np.searchsorted(self.known, g)
        copies = self.first[known + 1] - self.first[known]
        row = np.repeat(np.arange(len(g)), copies)
        at = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies) + self.first[known][row]
        item, doc, place = self.items.item[at], doc[row], place[row]
        diagonal = place - self.items.place[at]
        order = np.lexsort((diagonal, item, doc))
        item, doc, place, diagonal = item[order], doc[order], place[order], diagonal[order]
        begins = np.ones(len(order), bool)
        begins[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > self.sizes[item[1:]] // 2 + 2)
        number = np.cumsum(begins) - 1
        order = np.lexsort((place, number))
        other = np.ones(len(order), bool)
        other[1:] = (np.diff(number[order]) > 0) | (np.diff(place[order]) > 0)
        seeds = np.bincount(number[order][other])
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(number)) - 1
        good = seeds >= self.items.needed[item[start]]
        return zip(*(x[good].tolist() for x in (doc[start], item[start], diagonal[start], diagonal[end], seeds)), strict=True)

    def reaches(self, i: int, passage: np.ndarray) -> bool:
        """Whether the words that the passage shares with the item could be enough."""
        ordered = self.sorted[i]
        near = ordered[np.minimum(np.searchsorted(ordered, passage), len(ordered) - 1)] == passage
        return 2 * int(near.sum()) >= min(self.items.need[i], 2 * self.items.run)

    def matches(self, w: np.ndarray, first: np.ndarray, g: np.ndarray, doc: np.ndarray, at: np.ndarray):
        """(text, item, score, first word, last word, seeds) of the best passage of each text and item that is reported."""
        best: dict[tuple[int, int], tuple] = {}
        for d, i, low, high, seeds in self.passages(g[at], doc, at - first[doc]) if len(at) else ():
            n, text = len(self.items.words[i]), w[first[d] : first[d + 1]]
            low = max(0, low - 2 - n // 4)
            passage = text[low : high + n + 2 + n // 4]
            if not self.reaches(i, passage):
                continue
            s, a, b = align(self.items.words[i], passage)
            if s < self.items.need[i] and (s < 2 * self.items.run or longest_run(self.items.words[i], passage) < self.items.run):
                continue
            if (d, i) not in best or s > best[d, i][0]:
                best[d, i] = (s, low + a, low + b, seeds)
        for (d, i), (s, a, b, seeds) in best.items():
            yield d, i, s / (2 * len(self.items.words[i])), a, b, seeds


def _scan(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        scanner, ids = Scanner(shared.value), shared.value.ids
        for batch in batches:
            names, rows = batch.column(0).to_pylist(), []
            for row, w, first, g, doc, at in _hits(batch.column(1), scanner.lookup):
                rows += [(names[row + d], ids[i], *rest) for d, i, *rest in scanner.matches(w, first, g, doc, at)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word", "seeds"])

    return docs.mapInArrow(tidy(run), SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, stride: int = STRIDE, min_words: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """A row for each document and item that it holds: score (1: a full match), words of the document, seeds met."""
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    tests = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), text_of(benchmark).alias("text"))
    chars = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, out = -(-chars // BLOCK_CHARS), spark.createDataFrame([], SCHEMA)
    for k in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = Items([r[0] for r in rows], [r[1] for r in rows], min_words, threshold, run)
        if items.words:
            items.choose(_count(texts, items), stride)
            found = _scan(texts, items)
            out = found if k == 0 else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with their own columns, that hold no test item."""
    from fluxgrid.llm.common import BROADCAST_IDS, Workspace

    hits = Workspace(docs.sparkSession, "decontaminate").write(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "hits")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_IDS else hits.hint("merge")
    # In a struct, the documents' own columns can't clash with those of the hits.
    rows = docs.select(F.struct("*").alias("doc"))
    return rows.join(hits, F.col("doc")["doc_id"].eqNullSafe(hits["doc_id"]), "left_anti").select("doc.*")
