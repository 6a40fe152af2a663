"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("row", "key", "digest", "set", "n", "a", "b", "first", "label", "score", "bucket", "doc", "gone", "new", "__hits", "__row", "__hit", "part", "token", "best")


def words(r, n, vocabulary=400):
    return [f"w{int(r.random() ** 2 * vocabulary)}x" for _ in range(n)]


def corpus(seed=1, n=60):
    """(doc_id, text): originals, edited and exact copies, shared passages and lines, odd texts."""
    r = random.Random(seed)
    shared = " ".join(words(r, 40))
    line = " ".join(words(r, 12))
    out = []
    for i in range(n):
        w = words(r, r.choice((3, 8, 30, 120, 300)))
        text = "\n".join(" ".join(w[k : k + 15]) for k in range(0, len(w), 15))
        kind = i % 6
        if kind == 1 and out:
            text = out[r.randrange(len(out))][1] or text
        elif kind == 2 and out:
            t = (out[r.randrange(len(out))][1] or text).split(" ")
            for _ in range(max(1, len(t) // 60)):
                t[r.randrange(len(t))] = "edited"
            text = " ".join(t)
        elif kind == 3:
            text = f"{text}\n{shared}\n{line}"
        elif kind == 4:
            text = f"{line}\n{text}  \t{text[:150]}\r\n{line} more"
        out.append((i * 3, text))
    long = " ".join(words(r, 6000, 5000))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "One  TWO"), (1005, "é Ü 中文 \U0001f600 ñandú"), (1006, long), (1007, long + " end"), (1008, "aaaa " * 300), (1009, "x" * 500), (1010, shared), (None, shared + " tail"), (1011, "<|endoftext|> </s>[INST] \\ [/INST]")]
    return out


def table(spark, rows, partitions=3):
    full = [(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def stored(spark, rows, folder, partitions=3):
    """The same as a table read from files, as operators that number rows want it."""
    table(spark, rows, partitions).write.mode("overwrite").parquet(str(folder))
    return spark.read.parquet(str(folder))


def clashing(df):
    return df.select("*", *(F.lit(1).alias(c) for c in EXTRA))
