"""Exact duplicates by a tree merge of sorted digest runs.

Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]. Every input partition is a leaf with a
run of (digest, count, best row). In each round, `fan_in` neighbouring nodes of the tree exchange their runs, dealt by
digest, and a sort-based aggregation merges them, so equal digests meet, their counts add up and the best row stays.
A group that holds a third of all rows shrinks to one entry a leaf before anything is exchanged.

The digest is SHA-256. Each entry also carries an independent 64-bit hash and the normalised length, as minimum and
maximum; a merge whose members differ there stops the query instead of joining different texts.

Of equal texts the row with the most code points stays, then the smallest doc_id (null last), then one of the repeated
rows. A null text counts as empty; empty texts are equal to each other. Extra columns of any name are not read. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.common import SPACES, Workspace, text_of

FAN_IN = 8


def digests(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    plain = F.translate(text, SPACES, "")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.length(text).cast("long").alias("n"), plain.alias("plain")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n", F.unhex(F.sha2("plain", 256)).alias("digest"), F.struct(F.octet_length("plain").alias("bytes"), F.xxhash64("plain").alias("hash")).alias("check")
    )


def merge_tree(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One entry for each digest. `row` holds the input partition above bit 33, which is the leaf."""
    leaves = max(1, rows.select(F.max(F.shiftright("row", 33))).first()[0] or 0) + 1
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    runs = rows.select(F.shiftright("row", 33).alias("node"), "digest", F.lit(1).cast("long").alias("size"), best.alias("best"), F.col("check").alias("low"), F.col("check").alias("high"))
    while True:
        runs = runs.groupBy("node", "digest").agg(F.sum("size").alias("size"), F.min("best").alias("best"), F.min("low").alias("low"), F.max("high").alias("high"))
        if leaves == 1:
            break
        leaves = -(-leaves // fan_in)
        runs = runs.withColumn("node", F.floor(F.col("node") / fan_in))
    same = F.when(F.col("low") == F.col("high"), F.col("best")).otherwise(F.raise_error(F.lit("equal digests of different texts")))
    return runs.select("digest", "size", same.alias("best"))


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    work = Workspace(docs.sparkSession, "exact-dedup")
    rows = work.write(digests(docs), "digests")
    groups = merge_tree(rows, fan_in).withColumnRenamed("digest", "of")
    return rows.join(groups, rows["digest"] == groups["of"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
