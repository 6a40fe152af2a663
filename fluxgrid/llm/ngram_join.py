"""N-gram Jaccard join by parity sketches.

A document's set S holds its distinct 5-word shingles as 64-bit hashes. Its sketch XORs them into blocks: the top bits of
a hash name one of g blocks, whose word becomes the XOR of the hashes that fall there. A shingle in which two documents
differ changes one block at most, so

    number of blocks that differ <= |symmetric difference| <= floor(min(|A|, |B|) / 3)   for Jaccard >= 3/4,

and by the pigeonhole principle the first floor(|S| / 3) + 1 non-empty blocks of two linked documents, under any common
order of blocks, share one: those blocks are the join keys. g depends on the size band (sizes within a factor of 8; under
64 each shingle is a block); a document whose partners may be of the band below has the keys of both.

Blocks that many documents have (counted over all of them, in lossy summaries of bounded size) come last in the order,
so shared passages make no candidates among documents that hold little else. The order changes the work, never the
result. Copies (equal sets) are one class from the start.

Candidates pass a second sketch, folded to about 2 bits a shingle, whose Hamming distance also bounds the symmetric
difference from below, and then the exact sets. First every class meets the smallest class of each of its keys, and in
keys with many members its neighbour in an order that differs from key to key, which joins large groups. Where
the members of a key are then still of different components, the pairs between components follow: those of small keys by
pairs, those of large keys by rows that carry their sketches, once for all keys with the same members and in cells of
bounded size. No pair within a component is
made there, and no link between different components is lost.

Null texts count as empty; documents without words are linked with nothing. A null doc_id counts as the smallest,
as -2^63, which therefore comes back as null. Very long texts are one set of shingles held by one worker, about 16 bytes a
word. Rows that repeat are one class. Extra columns are not read. An empty table gives no rows. Different sets with equal 64-bit
sums are told apart by a second sum; the query stops if both are equal and the sizes are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.llm.common import BROADCAST_IDS, Workspace, only_ids, text_of, tidy
from fluxgrid.llm.components import components
from fluxgrid.llm.shingles import mix, shingle_sets

SIZE = 5
#: Share of documents from which a block counts as common, and how many such blocks are kept (8 bytes each, broadcast).
COMMON, MOST_COMMON = 0.0003, 200_000
#: Documents whose blocks are counted together.
COUNTED = 2_000
#: Members of a key up to which pairs are formed before their sketches are fetched, and members that meet in one task.
SMALL, CELL = 6, 2_000
#: Members of a key from which they meet in a chain first.
CROWD = 16
NO_ID = -(1 << 63)


def band(n: np.ndarray | int) -> np.ndarray | int:
    """Bits that name a block: 64 (one block a shingle) under 64 shingles, else 9, 12, 15, ... for each factor of 8."""
    n = np.asarray(n)
    bits = 9 + 3 * ((np.log2(np.maximum(n, 64)) + 1e-9) // 3 - 2).astype(int)
    return np.where(n < 64, 64, np.minimum(bits, 48))


def bands(n: int) -> list[int]:
    """Of a document of n shingles and of its smallest possible partner."""
    return sorted({int(band(n)), int(band(-(-3 * n // 4)))})


def block_words(s: np.ndarray, bits: int) -> np.ndarray:
    """The words of the non-empty blocks, in order; the band and the block's number are mixed into each."""
    salted = mix(s + np.uint64(bits))
    if bits == 64:
        return salted
    block = s >> np.uint64(64 - bits)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    return mix(np.bitwise_xor.reduceat(salted, first) + mix(block[first] + np.uint64(bits)))


def keys_of(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The join keys: in each band, of n // 3 + 1 blocks, rare ones first."""
    out = []
    for bits in bands(len(s)):
        words, most = block_words(s, bits), len(s) // 3 + 1
        if len(common) and len(words) > most:
            at = np.minimum(np.searchsorted(common, words), len(common) - 1)
            words = words[np.argsort(common[at] == words, kind="stable")]
        out.append(words[:most])
    return np.concatenate(out)


def sums(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for a set."""
    a, b = mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype="u8"), mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype="u8")
    return int(a.astype("i8")), int(b.astype("i8"))


def folded(s: np.ndarray) -> bytes:
    """Parities of the shingles that fall on each of m bits, m the power of two from 2 bits a shingle."""
    m = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((mix(s) & np.uint64(m - 1)).astype("i8"), minlength=m) & 1).astype("u1"), bitorder="little").tobytes()


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def close_sizes(n: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of different labels whose sizes allow a link."""
    order = np.argsort(n, kind="stable")
    ends = np.searchsorted(n[order], 4 * n[order] // 3, "right")
    left = [np.repeat(i, e - i - 1) for i, e in enumerate(ends) if e > i + 1]
    right = [np.arange(i + 1, e) for i, e in enumerate(ends) if e > i + 1]
    if not left:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    i, j = order[np.concatenate(left)], order[np.concatenate(right)]
    some = label[i] != label[j]
    return i[some], j[some]


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two folded sketches, the longer one folded on."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum())


def _ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the smaller member first."""
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), "i8")
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple] | None]:
    """Runs of rows with equal first `keys` columns; None after each batch."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
        yield None
    if held:
        yield held
        yield None


def small_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, digest, label, n in, sorted by key: the pairs of each key that sizes and labels allow."""
    found: list[tuple] = []
    for group in _groups(batches, 1):
        if group is None:
            a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, "i8") for k in (0, 1))
            yield _ordered(a, b)
            found = []
        elif len(group) > 1:
            _, digest, label, n = (np.array(c, "i8") for c in zip(*group, strict=True))
            i, j = close_sizes(n, label)
            found.append((digest[i], digest[j]))


def near(bits: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of folded sketches are `most` bits apart at most."""
    words = np.array([len(b) for b in bits])
    width, good = np.minimum(words[i], words[j]), np.zeros(len(i), bool)
    for w in np.unique(width):
        rows = np.flatnonzero(words >= w)
        place = np.zeros(len(bits), "i8")
        place[rows] = np.arange(len(rows))
        table, some = np.stack([_fold(bits[r], w) for r in rows]), np.flatnonzero(width == w)
        for part in np.array_split(some, max(1, len(some) * int(w) // 2_000_000)):
            good[part] = np.bitwise_count(table[place[i[part]]] ^ table[place[j[part]]]).sum(1, dtype="i8") <= most[part]
    return good


def large_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """crowd, lo, hi, cell, digest, label, n, sketch in, sorted by crowd and cells: pairs that the sketches allow as well."""
    for group in _groups(batches, 3):
        if group is None or len(group) < 2:
            continue
        lo, hi = group[0][1:3]
        cell, digest, label, n = (np.array(c, "i8") for c in list(zip(*group, strict=True))[3:7])
        i, j = close_sizes(n, label)
        if lo != hi:
            across = cell[i] != cell[j]
            i, j = i[across], j[across]
        good = near([np.frombuffer(r[7], "u8") for r in group], i, j, (n[i] + n[j]) // 7)
        yield _ordered(digest[i[good]], digest[j[good]])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of(docs).alias("text"), F.monotonically_increasing_id().alias("row"))


def _set_rows(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of so many rows, and the sets of their texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, list(shingle_sets(part.column(1), SIZE))


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), class_id (of equal sets) and row of every row."""
    spark = docs.sparkSession
    work, numbered = Workspace(spark, "ngram-join"), _texts(docs)
    texts = numbered.drop("row")

    def describe(batches):
        """A row for each document, and the common blocks of each batch as rows without doc_id."""
        for batch, sets in _set_rows(batches, COUNTED):
            seen, blocks = set(), []
            described = [(*sums(s), len(s)) for s in sets]
            for s, d in zip(sets, described, strict=True):
                if len(s) and d not in seen:
                    seen.add(d)
                    blocks += [block_words(s, bits) for bits in bands(len(s))]
            word, count = np.unique(np.concatenate(blocks) if blocks else np.zeros(0, "u8"), return_counts=True)
            some = count >= max(2, len(seen) * COMMON)
            word, count = word[some].astype("i8"), count[some]
            more = len(word)
            cols = [[*(d[0] for d in described), *word.tolist()], [*(d[1] for d in described), *[0] * more], [*(d[2] for d in described), *count.tolist()]]
            sketches = pa.array([*(folded(s) if len(s) else None for s in sets), *[None] * more], pa.binary())
            ids = [pa.concat_arrays([batch.column(k), pa.nulls(more, pa.int64())]) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, pa.int64()) for c in cols), sketches], names=["doc_id", "row", "digest", "second", "n", "sketch"])

    described = work.write(numbered.mapInArrow(tidy(describe), "doc_id long, row long, digest long, second long, n long, sketch binary"), "described")
    rows = described.where("doc_id is not null").select("doc_id", "row", "digest", "n")
    blocks = described.where("doc_id is null").groupBy("digest").agg(F.sum("n").alias("n"))
    total = rows.count()
    found = blocks.where(F.col("n") >= max(8, COMMON * total)).orderBy(F.desc("n"), "digest").limit(MOST_COMMON).select("digest").toArrow()
    common = spark.sparkContext.broadcast(np.sort(found.column(0).to_numpy().astype("u8")))

    one = F.when(F.min(F.struct("second", "n")) == F.max(F.struct("second", "n")), F.min("n")).otherwise(F.raise_error(F.lit("equal sums of different sets")))
    classes = described.where("doc_id is not null and n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), one.alias("n"), F.max("sketch").alias("sketch"))
    classes = work.write(classes, "classes")

    def keys(batches):
        for _, sets in _set_rows(batches):
            mine = {sums(s)[0]: s for s in sets if len(s)}
            each = [keys_of(s, common.value) for s in mine.values()]
            if each:
                digest = np.repeat(np.array(list(mine), "i8"), [len(k) for k in each])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).astype("i8")), pa.array(digest)], names=["key", "digest"])

    def shared(batches):
        """The keys that two classes or more have: rows sorted by key and digest in, repeated ones dropped."""
        last_key, last, head, told = None, None, None, True
        for batch in batches:
            k, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            new_key = np.concatenate([[last_key is None or k[0] != last_key], k[1:] != k[:-1]])
            keep = new_key | np.concatenate([[last is None or d[0] != last], d[1:] != d[:-1]])
            end_key, end = k[-1], d[-1]
            k, d, new_key = k[keep], d[keep], new_key[keep]
            if len(k):
                if not new_key[0] and not told:
                    k, d, new_key = np.insert(k, 0, last_key), np.insert(d, 0, head), np.insert(new_key, 0, True)
                    carried = None
                else:
                    carried = head if not new_key[0] else None
                first = np.flatnonzero(new_key)
                if carried is not None:
                    heads = np.concatenate([[carried], d[first]])[np.cumsum(new_key)]
                else:
                    heads = d[first][np.cumsum(new_key) - 1]
                follows = ~new_key
                more = np.concatenate([follows[1:], [False]])
                out = follows | more
                # Runs at the edges of a batch may go on in another one.
                run = np.cumsum(new_key)
                many = (np.bincount(run)[run] > 2) | (run == run[0]) | (run == run[-1])
                yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(d[out]), pa.array(heads[out]), pa.array(many[out])], names=["key", "digest", "head", "many"])
                head, told = heads[-1], bool(out[-1])
            last_key, last = end_key, end

    met = texts.mapInArrow(tidy(keys), "key long, digest long").repartition("key").sortWithinPartitions("key", "digest").mapInArrow(tidy(shared), "key long, digest long, head long, many boolean")
    met = work.write(met, "shared")
    of = {x: classes.select(F.col("digest").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"}

    def screen(pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and folded sketches allow."""

        def run(batches):
            for batch in batches:
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                good = [apart(np.frombuffer(p, "u8"), np.frombuffer(q, "u8")) <= t for p, q, t in zip(x, y, ((n + m) // 7).tolist(), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        met_sizes = pairs.join(of["a"].drop("sketch_a"), "a").join(of["b"].drop("sketch_b"), "b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
        with_sketch = met_sizes.join(of["a"].drop("n_a"), "a").join(of["b"].drop("n_b"), "b")
        return with_sketch.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")

    def sets(batches):
        for _, found in _set_rows(batches):
            found = {sums(s)[0]: s for s in found if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([(s >> np.uint64(16)).tobytes() for s in found.values()], pa.binary())], names=["digest", "members"])

    def compare(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            same = np.array([len(np.intersect1d(np.frombuffer(p, "u8"), np.frombuffer(q, "u8"), assume_unique=True)) for p, q in zip(x, y, strict=True)], "i8")
            size = np.array([(len(p) + len(q)) // 8 for p, q in zip(x, y, strict=True)], "i8")
            good = 100 * same >= 75 * (size - same)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, "i8")[good]), pa.array(np.array(b, "i8")[good])], names=["a", "b"])

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are links, by the exact sets of their members, read anew from the documents."""
        pairs = work.write(pairs, f"open-{name}")
        wanted = work.write(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(classes.select("digest", "first"), "digest"), f"wanted-{name}")
        few = only_ids(texts, wanted.select(F.col("first").alias("doc_id")), "doc_id", wanted.count())
        held = few.mapInArrow(tidy(sets), "digest long, members binary").join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
        held = work.write(held, f"sets-{name}")
        left, right = (held.select(F.col("digest").alias(k), F.col("members").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return work.write(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(compare), "a long, b long"), name)

    of_key = Window.partitionBy("key")
    star = met.where("digest <> head").select("digest", F.col("head").alias("other"))
    # A sample of the keys is enough here: what it leaves apart meets below.
    crowd = met.where("many and pmod(xxhash64(key), 4) = 0").select("key", "digest", F.count("*").over(of_key).alias("size")).where(F.col("size") > CROWD)
    chain = crowd.select("digest", F.lag("digest").over(of_key.orderBy(F.xxhash64("key", "digest"))).alias("other")).where("other is not null")
    tried = star.unionAll(chain).select(F.least("digest", "other").alias("a"), F.greatest("digest", "other").alias("b")).distinct()
    tried = work.write(tried, "tried")
    links = verify(screen(tried), "links-0")
    labels = components(links, work, "stars-0")

    named = classes.select("digest", "n").join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "n", F.coalesce("label", "digest").alias("label"))
    mixed = met.where("many").select("key", "digest").join(named, "digest").select("*", F.count("*").over(of_key).alias("size"), F.min("label").over(of_key).alias("low"), F.max("label").over(of_key).alias("high"))
    mixed = work.write(mixed.where("low <> high").select("key", "digest", "label", "n", "size", "low"), "mixed")
    small = mixed.where(F.col("size") <= SMALL).select("key", "digest", "label", "n").repartition("key").sortWithinPartitions("key").mapInArrow(small_pairs, "a long, b long")
    # Large keys with the same smallest label mostly have the same members: these meet once.
    crowds = mixed.where(F.col("size") > SMALL).select(F.col("low").alias("crowd"), "digest", "label", "n").distinct()
    cells = F.ceil(F.count("*").over(Window.partitionBy("crowd")) / CELL).cast("int")
    large = crowds.withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("digest"), F.col("cells")).cast("int"))
    large = large.join(classes.select("digest", "sketch"), "digest").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    large = large.select("crowd", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"), "cell", "digest", "label", "n", "sketch")
    large = large.repartition("crowd", "lo", "hi").sortWithinPartitions("crowd", "lo", "hi").mapInArrow(large_pairs, "a long, b long")
    more = verify(screen(small.unionAll(large).distinct().join(tried, ["a", "b"], "left_anti")), "links-1")
    if more.isEmpty():
        final = labels
    else:
        final = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(more), work, "stars-1")
    named = classes.join(final.withColumnRenamed("node", "digest"), "digest", "left").select("digest", F.col("first"), F.coalesce("label", "digest").alias("label"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    ends = work.write(named.join(lowest, "label").select("digest", F.col("first").alias("class_id"), "component_id"), "ends")
    work.drop("shared", "mixed", "tried", "links-0", "links-1", "classes", *(f"{x}-links-{i}" for x in ("open", "wanted", "sets") for i in (0, 1)))
    back = {c: F.when(F.coalesce(c, "doc_id") != NO_ID, F.coalesce(c, "doc_id")).alias(c) for c in ("component_id", "class_id", "doc_id")}
    return rows.join(ends, "digest", "left").select(back["doc_id"], F.col("n").alias("n_shingles"), back["component_id"], back["class_id"], "row")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, but one of each component: of the smallest doc_id, the first row.

    Documents without words all stay. `docs` must be a table read from files."""
    work = Workspace(docs.sparkSession, "ngram-keep")
    rows = work.write(ngram_components(docs).where("n_shingles > 0").select("component_id", "doc_id", "row"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "row"))
    stay = rows.groupBy("component_id").agg(first.alias("first")).select("first.row")
    gone = work.write(rows.select("row").join(stay, "row", "left_anti"), "gone")
    work.drop("rows")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge")
    # In a struct, the documents' own columns can't clash with the row number.
    numbered = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    return numbered.join(gone, "row", "left_anti").select("doc.*")
