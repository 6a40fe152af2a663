"""Packing by power-of-two decomposition.

A document of N ids is cut into N // context pieces of the context length and one piece for each set bit of the rest,
longest first. Every piece is a sequence of its own, so no sequence crosses documents and none needs padding; sequences
of equal length form a bucket, from which batches are drawn.

Nothing is shuffled: a sequence's number is made of the partition and a counter in it, as in
monotonically_increasing_id. Null texts count as empty; an empty document still has its end id, so every row gives at
least one piece. Repeated rows are packed once each. Null doc_ids stay null. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fluxgrid.llm.common import text_of, tidy
from fluxgrid.llm.tokens import blocks, encoder

CONTEXT = 2048
SCHEMA = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long, bucket int"


def binary_lengths(n: int, context: int) -> list[int]:
    """Lengths of the pieces of n ids: whole contexts, then the powers of two of the rest."""
    rest = n % context
    return [context] * (n // context) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, context: int = CONTEXT, digest: bool = False) -> DataFrame:
    """A row for each piece. digest: the unsigned crc32 of the ids (32-bit, little-endian) as ids_crc32 instead of ids."""
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, number = encoder(tokenizer), TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in blocks(texts):
                rows: list[list] = [[], [], [], [], [], []]
                for i, raw in zip(range(lo, hi), words.encode(texts[lo:hi]), strict=True):
                    ids = np.frombuffer(raw, dtype=words.dtype).astype("<u4").tobytes() + end
                    total, start = len(ids) // 4, 0
                    for length in binary_lengths(total, context):
                        part = ids[4 * start : 4 * (start + length)]
                        for to, x in zip(rows, (i, start, length, zlib.crc32(part) if digest else np.frombuffer(part, "<i4"), total, number), strict=True):
                            to.append(x)
                        start, number = start + length, number + 1
                at, begin, size, got, total, seq = rows
                size = np.array(size, dtype="i8")
                bits = np.log2(np.maximum(size, 1)).astype("i4")
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(at, pa.int64())), pa.array(begin, pa.int64()), pa.array(size), pa.array(got, pa.int64() if digest else pa.list_(pa.int32())), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(np.zeros(len(at), "i8")), pa.array(bits)],
                    names=["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset", "bucket"],
                )

    schema = SCHEMA.replace("ids array<int>", "ids_crc32 long") if digest else SCHEMA
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(tidy(cut, keep=True), schema)
