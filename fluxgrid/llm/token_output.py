"""Token ids in Arrow files whose batches hold fixed-size lists.

Layout of a dataset folder:
  tokens/part-<partition>-<attempt>.arrow  Arrow files (random access); each row is a sequence of seq_len ids and the
                                           mask of those that are no padding. Ids flow on from document to document;
                                           only the last sequence of a file is padded. A memory-mapped reader reaches
                                           any sequence without copying.
  index                                    Parquet: file, partition, doc_id, start in the file, n_tokens. Only the files
                                           of tasks that ended well are named here; others are left unread.
Documents are dealt by ranges of doc_id, so the files in order of their partition hold them in ascending doc_id order
(null first, equal doc_ids by text). Null texts count as empty: their only id is the end id. Repeated rows are written
once each. Other columns are not read. An empty table gives an empty index and no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm.common import text_of
from fluxgrid.llm.tokens import blocks, encoder

SEQ_LEN = 2048
#: Sequences in a batch: 1 MB of 16-bit ids.
BATCH = 256


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Sequences:
    """Cuts a stream of ids into sequences and writes them in batches."""

    def __init__(self, uri: str, dtype: np.dtype, seq_len: int):
        where, path = _store(uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink, self.seq_len, self.dtype = where.open_output_stream(path), seq_len, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.writer, self.left, self.n = pa.ipc.new_file(self.sink, self.schema), [], 0

    def add(self, ids: np.ndarray) -> None:
        self.left.append(ids)
        self.n += len(ids)
        if self.n >= BATCH * self.seq_len:
            whole = np.concatenate(self.left)
            keep = len(whole) // (BATCH * self.seq_len) * BATCH * self.seq_len
            for start in range(0, keep, BATCH * self.seq_len):
                self._write(whole[start : start + BATCH * self.seq_len], BATCH * self.seq_len)
            self.left, self.n = [whole[keep:]], len(whole) - keep

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n:
            ids = np.concatenate(self.left)
            self._write(np.concatenate([ids, np.zeros(-len(ids) % self.seq_len, self.dtype)]), len(ids))
        self.writer.close()
        self.sink.close()


class SequenceFile:
    """Random access to the sequences of one file, and to any range of its ids."""

    def __init__(self, uri: str):
        where, path = _store(uri)
        from pyarrow import fs

        self.source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self.at, self.flat = -1, None

    def _batch(self, i: int) -> np.ndarray:
        if i != self.at:
            self.at, self.flat = i, self.reader.get_batch(i).column(0).flatten().to_numpy()
        return self.flat

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of the i-th sequence."""
        batch, row = self.reader.get_batch(i // BATCH), i % BATCH
        return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        size, out = BATCH * self.seq_len, []
        while n > 0:
            piece = self._batch(start // size)[start % size : start % size + n]
            out.append(piece)
            start, n = start + len(piece), n - len(piece)
        return out[0] if len(out) == 1 else np.concatenate(out)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, seq_len: int = SEQ_LEN) -> DataFrame:
    """Writes the dataset and returns its index. One shuffle of the texts, dealt by ranges of doc_id."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, out, at = TaskContext.get().partitionId(), encoder(tokenizer), None, 0
        uri = f"{folder}/tokens/part-{part:06d}-{uuid.uuid4().hex[:12]}.arrow"
        end = np.array([end_id], words.dtype)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = out or _Sequences(uri, words.dtype, seq_len)
            starts, sizes = [], []
            for lo, hi in blocks(texts):
                for raw in words.encode(texts[lo:hi]):
                    ids = np.concatenate([np.frombuffer(raw, words.dtype), end])
                    out.add(ids)
                    starts.append(at)
                    sizes.append(len(ids))
                    at += len(ids)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array([part] * n, pa.int32()), batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "partition", "doc_id", "file_start", "n_tokens"])
        if out:
            out.close()

    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    index = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, "file string, partition int, doc_id long, file_start long, n_tokens long")
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files named in the index."""
    index = spark.read.parquet(f"{folder}/index")
    # One row for each file: as many as tasks wrote.
    totals = index.groupBy("partition", "file").agg(F.sum("n_tokens").alias("n")).orderBy("partition").collect()
    base, bases = 0, []
    for row in totals:
        bases.append((row["file"], base))
        base += row["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            sums = []
            for uri, start, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if uri != name:
                    name, file = uri, SequenceFile(uri)
                sums.append(zlib.crc32(file.ids(start, n).astype("<u4").tobytes()))
            begin = pa.compute.add(batch.column(4), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(1), begin, batch.column(3), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    import pyarrow.compute  # noqa: F401

    rows = index.select("file", "doc_id", "file_start", "n_tokens")
    if not bases:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(spark.createDataFrame(bases, "file string, base long"), "file").select("file", "doc_id", "file_start", "n_tokens", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
