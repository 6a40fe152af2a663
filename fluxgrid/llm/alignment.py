"""How the tokens of two vocabularies lie over the same text: groups between common ends, and linked pairs.

A is a byte-level vocabulary over space + text, B a piece vocabulary that adds the space itself. Both always begin a token
at a single space between visible characters, so a text is the sequence of its segments, cut there, and what holds for
a segment holds wherever it occurs. Each task numbers the segments of a block of texts; distinct segments are tokenized
once for the whole corpus, and aligned by relations alone:

  posexplode of the token lengths; a window by segment sums them to byte ends; the equi-join of both sides on segment and
  end finds the ends that both share; running counts of those are the group numbers, and running counts of each side's
  ends before a place say which A and which B token cover the bytes up to it. Every end of either side closes one stretch
  that one A and one B token cover, and two tokens overlap in one stretch, so these rows are the range join of the
  tokens, in a number that grows with the tokens and never with their product.

Segments are aligned and blocks gathered in WAVES waves, dealt by hash, so that shuffle files take a fraction of the input.
The pairs of ids are counted over all segments, each as often as it occurs in the corpus. Segments get the sums over their
links, and each block gathers its segments' results for its texts. A segment that most blocks hold is a row for each
block, which adaptive execution splits; nothing is gathered by token id but counts that were added up before.

Texts that are null, empty, or hold U+2581, which B writes for spaces, have no tokens: zeros and ''. Every other text gives
back its bytes, since B must keep texts as they are (identity normalisation with byte fallback; other models are
refused). Each row is a document of its own, repeated rows and equal or null doc_ids too. A very long text is a long
list of segments; a text without cuts is one segment, whose tokens are rows. Other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.llm.common import Workspace, text_of, tidy

#: Characters of the texts of a block.
BLOCK = 12_000_000
#: Counted pairs up to which they are broadcast (16 bytes each, 64 MB in a hash table); beyond it they are joined by a shuffle.
BROADCAST = 1_000_000
#: Segments are aligned, and blocks gathered, in so many waves, each with its own shuffle files; up to ONE_WAVE segments in one.
WAVES, ONE_WAVE = 4, 200_000
_CUT = re.compile(r"(?<=\S)(?= \S)")
_BLOCKS = "block long, doc_ids array<long>, sizes array<int>, codes binary, words array<string>, counts array<long>"
_TOKENS = "word string, n long, a array<int>, b array<int>, a_size array<short>, b_size array<short>"
_REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def segments(text: str) -> list[str]:
    """The segments of space + text, without the space that each begins with."""
    return [s[1:] for s in _CUT.split(" " + text)]


class Segments(dict):
    """Numbers of segments. uncertain: of strings without a space inside that are no segments, since white space lies at an end."""

    def __init__(self):
        self.uncertain: set[int] = set()

    def __missing__(self, segment: str) -> int:
        number = self[segment] = len(self)
        if not segment or segment[0].isspace() or segment[-1].isspace():
            self.uncertain.add(number)
        return number

    def of(self, text: str) -> np.ndarray:
        own = text.split(" ")
        numbers = np.fromiter(map(self.__getitem__, own), "<i4", len(own))
        if self.uncertain and not self.uncertain.isdisjoint(numbers.tolist()):
            own = segments(text)
            numbers = np.fromiter(map(self.__getitem__, own), "<i4", len(own))
        return numbers


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as numbers of segments; size -1: no tokens."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    ids, sizes, codes, known, chars = [], [], [], Segments(), 0

    def block() -> pa.RecordBatch:
        every = np.concatenate([np.zeros(0, "<i4"), *codes])
        counts = np.bincount(every, minlength=len(known))
        values = [[(part << 32) + made], [ids], [sizes], [pa.compress(every.tobytes(), "zstd", asbytes=True)], [list(known)], [counts]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            ids.append(doc_id)
            if not text or "▁" in text:
                sizes.append(-1)
                continue
            codes.append(known.of(text))
            sizes.append(len(codes[-1]))
            chars += len(text)
            if chars >= BLOCK:
                yield block()
                made += 1
                ids, sizes, codes, known, chars = [], [], [], Segments(), 0
    if ids:
        yield block()


@lru_cache(maxsize=2)
def _vocabularies(path_a: str, path_b: str):
    """Both tokenizers, and the bytes of each of their ids."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(plain))}
    bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in a.get_vocab().items() if all(c in byte_of for c in t)}
    bytes_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, b, bytes_a, bytes_b


def check_model(path_b: str) -> None:
    """Refuses a piece model that changes texts before it cuts them, or has no byte pieces."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path_b, "rb") as f:
        model.ParseFromString(f.read())
    n = model.normalizer_spec
    whole = any("▁" in p.piece.lstrip("▁") for p in model.pieces)
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not model.trainer_spec.byte_fallback or whole:
        raise ValueError(f"{path_b}: the model needs identity normalisation, an added space, byte fallback and pieces within words")


def _tokenize(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, *tables = _vocabularies(path_a, path_b)
        lengths = []
        for table in tables:
            lengths.append(np.zeros(max(table) + 1, "i2"))
            lengths[-1][list(table)] = [len(v) for v in table.values()]
        for batch in batches:
            words = batch.column(0).to_pylist()
            raw = [(" " + w).encode() for w in words]
            whole, sizes = b"".join(raw), np.fromiter(map(len, raw), "i8", len(raw))
            ids_a = [e.ids for e in a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
            lists = []
            for ids, table, length in zip((ids_a, b.encode(words, num_threads=1)), tables, lengths, strict=True):
                flat, offsets = list(chain.from_iterable(ids)), np.append(0, np.cumsum(np.fromiter(map(len, ids), "i8", len(ids))))
                size = length[flat]
                if b"".join(map(table.__getitem__, flat)) != whole or (np.diff(np.append(0, np.cumsum(size, dtype="i8"))[offsets]) != sizes).any():
                    raise ValueError("a vocabulary does not give back the bytes of a segment")
                lists.append([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, t)) for v, t in ((flat, pa.int32()), (size, pa.int16()))])
            columns = [lists[0][0], lists[1][0], lists[0][1], lists[1][1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[c.split()[0] for c in _TOKENS.split(", ")])

    return run


def _ends(tokens: DataFrame, sizes: str, name: str) -> DataFrame:
    """(seg, end, name): the byte ends of a side's tokens."""
    rows = tokens.select("seg", F.posexplode(sizes).alias("pos", "size"))
    window = Window.partitionBy("seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("seg", F.sum("size").over(window).alias("end"), F.lit(True).alias(name))


def _joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def align_segments(tokens: DataFrame) -> DataFrame:
    """(seg, word, n, n_a, groups, links) of segments (seg, word, n, a, b, a_size, b_size); seg: distinct. links: B id * 2^32 +
    A id of each overlapping pair of tokens. Wants spark.sql.requireAllClusterKeysForCoPartition to be false, so that what
    is dealt by segment stays where it is when it is joined by segment and end."""
    dealt = tokens.select("seg", "a_size", "b_size").repartition("seg")
    line = _ends(dealt, "a_size", "in_a").hint("merge").join(_ends(dealt, "b_size", "in_b").hint("merge"), ["seg", "end"], "full_outer")
    before = Window.partitionBy("seg").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct("end", F.count("in_a").over(before).cast("int").alias("i"), F.count("in_b").over(before).cast("int").alias("j"), (F.col("in_a") & F.col("in_b")).alias("cut"))
    lines = line.select("seg", at.alias("at")).groupBy("seg").agg(F.sort_array(F.collect_list("at")).alias("line"))
    rows = tokens.select("seg", "word", "n", "a", "b").hint("merge").join(lines.hint("merge"), "seg")
    links = F.transform("line", lambda x: F.get("b", x["j"]).cast("long") * (1 << 32) + F.get("a", x["i"]))
    cuts = F.filter("line", lambda x: x["cut"])
    first = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"))), F.transform(F.col("cuts"), lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"))))

    def group(x: Column, k: Column) -> Column:
        start = F.get(F.col("first"), k)
        side = lambda ids, c: _joined(F.slice(ids, start[c] + 2, x[c] - start[c]))
        return F.concat(side("a", "i"), F.lit("|"), side("b", "j"))

    rows = rows.select("seg", "word", "n", "a", "b", F.size("a").alias("n_a"), links.alias("links"), cuts.alias("cuts")).withColumn("first", first)
    # A segment of one group: all its ids.
    groups = F.when(F.size("cuts") == 1, F.concat(_joined(F.col("a")), F.lit("|"), _joined(F.col("b")))).otherwise(F.array_join(F.transform("cuts", group), ";"))
    return rows.select("seg", "word", "n", "n_a", groups.alias("groups"), "links")


def _gather(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """The report of the texts of a block, from the results of its segments."""
    out = []
    found = found.combine_chunks()
    code = found["code"].to_numpy()
    place = np.zeros(int(code.max()) + 1 if len(code) else 0, "i8")
    place[code] = np.arange(len(code))
    n_a, n_best, count_sum = (found[c].to_numpy() for c in ("n_a", "n_best", "count_sum"))
    n_groups = pc.count_substring(found["groups"], "|").to_numpy()
    n_b = pc.count_substring(found["groups"], ",").to_numpy() + 2 * n_groups - n_a
    groups = found["groups"].to_pylist()
    for row in blocks.to_pylist():
        sizes = np.array(row["sizes"], "i8")
        held = np.maximum(sizes, 0)
        codes = np.frombuffer(pa.decompress(row["codes"], int(held.sum()) * 4, "zstd"), "<i4") if held.sum() else np.zeros(0, "<i4")
        codes = place[codes]
        ends = np.cumsum(held)
        sums = [np.diff(np.append(0, np.append(0, np.cumsum(v[codes].astype("i8")))[ends])) for v in (n_a, n_b, n_groups, n_best, count_sum)]
        digests = [hashlib.sha256(";".join(map(groups.__getitem__, codes[e - n : e].tolist())).encode()).hexdigest() if n > 0 else "" for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        a, b, g, best, total = sums
        out.append(pa.table([pa.array(row["doc_ids"], pa.int64()), *(pa.array(v, pa.int64()) for v in (a, b, g, a + b - g, best, total)), pa.array(digests, pa.string())], names=[c.split()[0] for c in _REPORT.split(", ")]))
    return pa.concat_tables(out)


def align_report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)"""
    check_model(path_b)
    spark = docs.sparkSession
    work = Workspace(spark, "alignment")
    blocks = work.write(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(tidy(_split), _BLOCKS), "blocks")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select("block", "code", F.col("w.words").alias("word"), F.col("w.counts").alias("n")).where("n > 0")

    distinct = words.groupBy("word").agg(F.sum("n").alias("n"))
    tokens = distinct.mapInArrow(tidy(_tokenize(path_a, path_b), keep=True), _TOKENS).select(F.monotonically_increasing_id().alias("seg"), "*")
    tokens = work.write(tokens, "tokens")
    work.settle()
    # A session of its own for the setting that align_segments wants.
    session = spark.newSession()
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    every = session.read.schema(tokens.schema).parquet(f"{work.root}/tokens")
    waves = WAVES if tokens.count() > ONE_WAVE else 1
    for k in range(waves):
        part = align_segments(every.where(F.pmod("seg", F.lit(waves)) == k))
        part.write.parquet(f"{work.root}/aligned-{k}")
        kept = part.schema
        del part
        work.settle()
    aligned = reduce(DataFrame.unionByName, (work.read(f"aligned-{k}", kept) for k in range(waves)))
    del every
    work.settle("tokens")

    counts = work.write(aligned.select(F.explode("links").alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    b_id = F.floor(F.col("pair") / (1 << 32))
    # A row for each id of B: bounded by its vocabulary.
    most = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))
    rated = counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    rated = F.broadcast(rated) if counts.count() <= BROADCAST else rated.hint("merge")
    sums = aligned.select("seg", F.explode("links").alias("pair")).join(rated, "pair").groupBy("seg").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    values = aligned.select("seg", "word", "n_a", "groups").hint("merge").join(sums.hint("merge"), "seg").drop("seg")
    values = work.write(values, "values")
    del aligned, sums, rated, most
    work.settle("counts", *(f"aligned-{k}" for k in range(waves)))

    mine = lambda df, k: df.where(F.pmod(F.xxhash64("block"), F.lit(waves)) == k)
    reports = []
    for k in range(waves):
        found = mine(words.select("block", "code", "word"), k).hint("merge").join(values.hint("merge"), "word").select("block", "code", "n_a", "n_best", "count_sum", "groups")
        sides = mine(work.read("blocks", blocks.schema).select("block", "doc_ids", "sizes", "codes"), k).groupBy("block").cogroup(found.groupBy("block"))
        reports.append(work.write(sides.applyInArrow(_gather, _REPORT), f"report-{k}"))
        del found, sides
        work.settle()
    return reduce(DataFrame.unionByName, reports)
