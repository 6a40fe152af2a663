"""How the word use of each source differs from that of the other sources of its language, in whole numbers.

Terms are the matches of [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ (letters, and every character beyond ASCII), A-Z lower-cased.
A language keeps the terms that at least `least` of its documents hold. With count occurrences of a term in a group, N
occurrences of all kept terms there and V kept terms, p = 1 + floor(10^9 (count + 1) / (N + V)), and the divergence of p
from q is f = floor((p - q)^2 / q).

Sort-based streaming. Each task sorts the terms of a block of documents by (term, source, document) and scans the runs:
a run of a document counts once as a document, its length as occurrences. These partial runs are added up by (language,
term, source), before the shuffle and after it, so that a term that every document holds, or a source with most of the
documents, reaches no task as a crowd. They are then dealt by (language, term), sorted by (language, term, source), and
a second scan reads the document frequency off each term's run. A third scan, over the kept terms, emits partial sums
for the pairs of sources that share a term. What a pair owes to the terms that one or none of both holds follows from
each source's histogram of counts:

  sum of f(p, q) = sum of f(p, q0) over a's terms + sum of f(p0, q) over b's + (V - terms of either) f(p0, q0)
                   + sum of f(p, q) - f(p, q0) - f(p0, q) over the terms of both,   p0, q0: the value for count 0

Nulls in text, lang and source count as ''. Each row is a document of its own, repeated rows and equal doc_ids too; doc_id
and other columns are not read. Documents without terms still make their (lang, source) a group. Very long texts are
split into terms a few MB at a time; memory holds 8 bytes for each of a text's terms. Equal values rank by item, in the
order of its UTF-8 bytes. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.llm.common import Workspace, tidy

#: Bytes of text that are sorted together.
BLOCK = 4_000_000
#: Pairs of sources that one step of the last scan holds.
PAIRS = 1_000_000
#: The scale of p.
UNIT = 1_000_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GAP = re.compile(rb"[\x00-\x40]")
_RUNS = "lang string, source string, term string, documents long, occurrences long"
_KEPT = "lang string, term string, source string, occurrences long, everywhere long, first boolean"


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins, in columns sorted together."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _codes(text: bytes, known) -> Iterator[np.ndarray]:
    """Numbers of the terms of a text, in pieces that end between terms."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK:
            gap = _GAP.search(text, at + BLOCK)
            end = gap.start() if gap else end
        terms = text[at:end].translate(_FOLD).split()
        yield np.fromiter(map(known, terms), "i8", len(terms))
        at = end


def _local_runs(langs: list[str], sources: list[str], texts: list[bytes]) -> pa.RecordBatch | None:
    """(lang, source, term, documents, occurrences) of a block of documents."""
    order = sorted(range(len(texts)), key=lambda i: (langs[i], sources[i]))
    groups = {}
    group = np.array([groups.setdefault((langs[i], sources[i]), len(groups)) for i in order])
    known = defaultdict(count().__next__)
    parts, docs = [], []
    for place, i in enumerate(order):
        for codes in _codes(texts[i], known.__getitem__):
            parts.append(codes)
            docs.append(np.full(len(codes), place))
    if not known:
        return None
    key = np.concatenate(parts) * len(order) + np.concatenate(docs)
    key.sort()
    at = _starts(key)
    sizes = np.diff(np.append(at, len(key)))
    term, doc = np.divmod(key[at], len(order))
    runs = _starts(term, group[doc])
    names = list(groups)
    g = group[doc[runs]]
    columns = [
        pa.array([n[0] for n in names], pa.string()).take(pa.array(g)),
        pa.array([n[1] for n in names], pa.string()).take(pa.array(g)),
        pa.array(list(known), pa.binary()).cast(pa.string()).take(pa.array(term[runs])),
        pa.array(np.diff(np.append(runs, len(term)))),
        pa.array(np.add.reduceat(sizes, runs)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RUNS.split(", ")])


def _scan_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs, sources, texts, size = [], [], [], 0
    for batch in batches:
        new = [c.to_pylist() for c in batch.columns[:2]]
        for lang, source, text in zip(*new, batch.column(2).cast(pa.large_binary()), strict=True):
            langs.append(lang)
            sources.append(source)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= BLOCK:
                if (out := _local_runs(langs, sources, texts)) is not None:
                    yield out
                langs, sources, texts, size = [], [], [], 0
    if texts and (out := _local_runs(langs, sources, texts)) is not None:
        yield out


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a (lang, term) ends, and where each begins in them; from batches sorted by both."""
    left = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([left, rows]) if left is not None else rows).combine_chunks()
        at = _run_starts(rows)
        if len(at) > 1:
            yield rows.slice(0, int(at[-1])), at[:-1]
            left = rows.slice(int(at[-1]))
        else:
            left = rows
    if left is not None and len(left):
        yield left, _run_starts(left)


def _run_starts(rows: pa.Table) -> np.ndarray:
    if len(rows) < 2:
        return np.arange(len(rows))
    new = pc.or_(*(pc.not_equal(rows[c].slice(1), rows[c].slice(0, len(rows) - 1)) for c in ("lang", "term")))
    return np.append(0, np.flatnonzero(new.to_numpy()) + 1)


def _scan_terms(least: int):
    """Keeps the runs of terms that enough documents hold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in _whole_runs(batches):
            sizes = np.diff(np.append(at, len(rows)))
            documents, occurrences = (rows[c].to_numpy() for c in ("documents", "occurrences"))
            keep = np.repeat(np.add.reduceat(documents, at) >= least, sizes)
            everywhere = np.repeat(np.add.reduceat(occurrences, at), sizes)
            first = np.zeros(len(rows), bool)
            first[at] = True
            more = rows.select(["lang", "term", "source", "occurrences"]).append_column("everywhere", pa.array(everywhere)).append_column("first", pa.array(first))
            yield from more.filter(pa.array(keep)).to_batches()

    return scan


def _scan_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, common, value): partial sums for the ordered pairs of groups that share terms."""

    def f(p, q):
        return (p - q) ** 2 // q

    for rows, at in _whole_runs(batches):
        group, p, base = (rows[c].to_numpy() for c in ("g", "p", "p0"))
        sizes = np.diff(np.append(at, len(rows)))
        reach = np.repeat(sizes, sizes)  # a row meets as many rows as its run has
        ends = np.cumsum(reach)
        low = 0
        while low < len(rows):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
            n = reach[low:high]
            a = np.repeat(np.arange(low, high), n)
            b = np.repeat(np.repeat(at, sizes)[low:high] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a, b = a[a != b], b[a != b]
            low = high
            if len(a) == 0:
                continue
            value = f(p[a], p[b]) - f(p[a], base[b]) - f(base[a], p[b])
            names, code = np.unique(group, return_inverse=True)
            found, where = np.unique(code[a] * len(names) + code[b], return_inverse=True)
            total = np.zeros(len(found), "i8")
            np.add.at(total, where, value)
            yield pa.RecordBatch.from_arrays([pa.array(names[found // len(names)]), pa.array(names[found % len(names)]), pa.array(np.bincount(where)), pa.array(total)], names=["a", "b", "common", "value"])


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _p(occurrences: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (N + V)), in decimals of 38 digits."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (occurrences + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.when(n + v > 0, _div(above, F.when(n + v > 0, n + v).cast("decimal(20,0)"))).otherwise(F.lit(0).cast("long"))


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def divergence(docs: DataFrame, top: int = 200, least: int = 3) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has every other source of the language, part 'term' the `top`
    terms that a group uses more than its language does."""
    work = Workspace(docs.sparkSession, "divergence")
    plain = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    runs = plain.mapInArrow(tidy(_scan_documents), _RUNS)
    whole = runs.groupBy("lang", "term", "source").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))
    dealt = whole.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = work.write(dealt.mapInArrow(_scan_terms(least), _KEPT), "kept")

    found = kept.groupBy("lang", "source").agg(F.sum("occurrences").alias("n"), F.count(F.lit(1)).alias("terms"))
    langs = kept.groupBy("lang").agg(F.sum("occurrences").alias("all_n"), F.sum(F.col("first").cast("long")).alias("v"))
    groups = plain.select("lang", "source").distinct().join(found, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n", "terms", "all_n", "v")))
    groups = work.write(groups.select(F.monotonically_increasing_id().alias("g"), "*", _p(zero, F.col("n"), F.col("v")).alias("p0")), "groups")

    rated = kept.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("occurrences"), F.col("n"), F.col("v")))
    q = _p(F.col("everywhere"), F.col("all_n"), F.col("v"))
    terms = rated.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    dealt = rated.select("lang", "term", "source", "g", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    shared = dealt.mapInArrow(_scan_pairs, "a long, b long, common long, value long").groupBy("a", "b").agg(F.sum("common").alias("common"), F.sum("value").alias("shared"))
    counts = rated.groupBy("g", "p").agg(F.count(F.lit(1)).alias("k")).groupBy("g").agg(F.collect_list(F.struct("p", "k")).alias("counts"))
    sides = work.write(groups.join(counts, "g", "left"), "sides")
    a, b = (sides.select("lang", *(F.col(c).alias(f"{c}_{k}") for c in ("g", "source", "terms", "p0", "counts")), *(["v"] if k == "a" else [])) for k in "ab")
    both = a.join(b, "lang").where("g_a <> g_b").join(shared.withColumnsRenamed({"a": "g_a", "b": "g_b"}), ["g_a", "g_b"], "left")

    def own(counts: str, f) -> Column:
        return F.coalesce(F.aggregate(F.col(counts), zero, lambda s, x: s + x["k"] * f(x["p"])), zero)

    rest = (F.col("v") - F.col("terms_a") - F.col("terms_b") + F.coalesce("common", zero)) * _f(F.col("p0_a"), F.col("p0_b"))
    value = own("counts_a", lambda p: _f(p, F.col("p0_b"))) + own("counts_b", lambda q: _f(F.col("p0_a"), q)) + rest + F.coalesce("shared", zero)
    pairs = both.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
