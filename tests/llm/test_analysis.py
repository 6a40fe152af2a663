"""Alignment of vocabularies, exact search and source divergence against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import clashing, corpus, table

from fluxgrid.llm import divergence as div
from fluxgrid.llm import topk
from fluxgrid.llm.alignment import Segments, _vocabularies, align_report, segments
from fluxgrid.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["a▁b", "▁", " ", "  two  spaces ", "x\n y\n\n z", "\x00nul \x01", "tab\tand\xa0nbsp　wide", "\x1c fs \x85nel", "naïve ÉTÉ 中文字 😀 👩‍👩‍👧", "<s> </s> <0x41> <unk> <|endoftext|>", "́combining ́x", "it's I'll", "a" * 300, "﷽" * 40, "end ", " start"]


def plain_alignment(text):
    a, b, bytes_a, bytes_b = _vocabularies(A, B)
    if not text:
        return None
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    if b"".join(bytes_a[i] for i in x) != raw or b"".join(bytes_b[i] for i in y) != raw:
        return None
    spans = []
    for ids, of in ((x, bytes_a), (y, bytes_b)):
        ends = np.cumsum([len(of[i]) for i in ids]).tolist()
        spans.append([(e - len(of[i]), e, i) for i, e in zip(ids, ends, strict=True)])
    links = [(q[2], p[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1]] if len(x) < 400 else None
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = ["|".join(",".join(str(i) for _, e, i in side if low < e <= high) for side in spans) for low, high in zip([0, *cuts], cuts, strict=False)]
    return len(x), len(y), len(cuts), links, ";".join(groups)


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr("fluxgrid.llm.alignment.ONE_WAVE", 10)
    rows = [(i, t) for i, t in corpus(n=24) if t is None or len(t) < 900]
    rows += [(5000 + k, t) for k, t in enumerate(ODD)] + [(5000, ODD[0]), (5002, "twice"), (5002, "twice")]
    want = [(i, plain_alignment(t)) for i, t in rows]
    count = Counter(pair for _, r in want if r for pair in r[3])
    most = defaultdict(int)
    for (b, _), n in count.items():
        most[b] = max(most[b], n)
    full = [(i, 0, 0, 0, 0, 0, 0, "") if r is None else (i, *r[:3], len(r[3]), sum(count[p] == most[p[0]] for p in r[3]), sum(count[p] for p in r[3]), hashlib.sha256(r[4].encode()).hexdigest()) for i, r in want]
    got = [tuple(r) for r in align_report(clashing(table(spark, rows)), A, B).collect()]
    assert Counter(got) == Counter(full)
    assert align_report(table(spark, []), A, B).count() == 0


def test_segments_tokenize_alone():
    """The ids of a text are those of its segments, for both vocabularies."""
    a, b, *_ = _vocabularies(A, B)
    r = random.Random(4)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\r\n", ".", ",", "'s", "é", "中", "23", "<s>", "▁", "</w>", "xyz", "́", "\x0b", "\x85", "\x00", "word", "();", "\xa0", "😀"]
    texts = [t for t in ("".join(r.choice(parts) + r.choice(("", " ")) for _ in range(r.randrange(1, 40))) for _ in range(2000)) if "▁" not in t] + [t for t in ODD if "▁" not in t]
    for t in texts:
        own = segments(t)
        assert " ".join(own) == t
        assert a.encode(" " + t, add_special_tokens=False).ids == [i for s in own for i in a.encode(" " + s, add_special_tokens=False).ids], t
        assert b.encode(t) == [i for s in own for i in b.encode(s)], t
        known = Segments()
        numbers = known.of(t)
        assert [list(known)[k] for k in numbers] == own, t


def vectors(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))


def plain_top_k(rows, k=5, every=50):
    kept = [(i, [min(1 << 53, max(-(1 << 53), math.floor(256 * float(np.float32(x))))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(q, v, strict=False)))), j) for b, (j, v) in enumerate(kept) if a != b]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(i, n + 1, j, s) for n, (s, j) in enumerate(scored[:k])]
    return Counter(out)


def hard_vectors(seed, n=400, width=12):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width)).round(1)
    rows = [(int(i) * 5, v.tolist()) for i, v in enumerate(x)]
    rows += [(50, rows[10][1]), (50, rows[10][1]), (None, rows[3][1]), (9000, None), (9050, []), (9100, [None] * width), (9150, [math.nan] * width), (9200, [math.inf] * width), (-50, [0.0] * width), (9250, [1.0, -2.0]), (9300, [1.0] * (width + 3))]
    return rows + [(7000 + k, rows[0][1]) for k in range(30)]


@pytest.mark.parametrize(("tile", "band", "chunk"), [(16_384, 8_192, 256), (40, 3, 2)])
def test_top_k(spark, monkeypatch, tile, band, chunk):
    # cloudpickle sends functions of a module by name, so small tiles are tried in this process
    rows = hard_vectors(1)
    assert Counter(tuple(r) for r in topk.top_k(vectors(spark, rows)).collect()) == plain_top_k(rows)
    x = np.array([v for _, v in rows[:400]])
    x = np.floor(256 * x).astype("i8")
    monkeypatch.setattr(topk, "CHUNK", chunk)
    tile_ = topk.Tile({"part": 0, "k": 0, "n": 400, "width": 12, "ids": np.arange(400).tobytes(), "known": np.ones(400, bool).tobytes(), "vectors": x.tobytes()})
    places = np.arange(0, 400, 7)
    for floors in (np.full(len(places), -np.inf), np.sort(x @ x[places].T, 0)[-6].astype("f8")):
        found = list(topk._found(tile_, topk.Lists(x), x, 0, places, places, x[places], floors, 5))
        got = [(int(q), int(v), int(s)) for f in found for q, v, s in zip(f["query_id"], f["vec_id"].to_pylist(), f["score"], strict=True)]
        want = []
        for p in places:
            s = x @ x[p]
            order = [j for j in np.lexsort((np.arange(400), -s)) if j != p][:5]
            want += [(int(p), int(j), int(s[j])) for j in order]
        assert sorted(got) == sorted(want)


def test_top_k_of_large_and_few_values(spark):
    rows = [(0, [3e38, 1.0]), (50, [3e38, -3e38]), (7, [-3e38, 2.0]), (8, [1.0, 1.0])]
    assert Counter(tuple(r) for r in topk.top_k(vectors(spark, rows)).collect()) == plain_top_k(rows)
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert topk.top_k(vectors(spark, [(50, [1.0])])).count() == 0
    assert topk.top_k(vectors(spark, [(1, [1.0]), (2, [2.0])])).count() == 0


def test_reading_stops_early():
    """Values in a few places: most vectors are outsiders long before the lists end."""
    r = np.random.default_rng(3)
    x = np.zeros((4000, 32), "i8")
    x[np.arange(4000), r.integers(0, 32, 4000)] = r.integers(1, 10_000, 4000)
    vector, _ = topk.contenders(topk.Lists(x), x[:64].astype("f8"), np.arange(64), np.full(64, -np.inf), 5)
    assert len(vector) * topk.CONTENDERS <= 4000 * 64


def plain_divergence(rows, top=200, least=3):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for text, lang, source in rows]
    frequency, counts = Counter(), Counter()
    for lang, source, terms in docs:
        frequency.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (g, t), n in frequency.items() if g == lang and n >= least)
        sources = sorted({d[1] for d in docs if d[0] == lang}, key=lambda s: s.encode())

        def p(c, n, kept=kept):
            return 1 + 10**9 * (c + 1) // (n + len(kept))

        each = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        rate = {s: {t: p(c, sum(v.values())) for t, c in v.items()} for s, v in each.items()}
        total = {t: sum(v[t] for v in each.values()) for t in kept}
        whole = {t: p(c, sum(total.values())) for t, c in total.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(rate[s][t], rate[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(rate[s][t], whole[t]), t) for t in kept if each[s][t] and rate[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return Counter(out)


def test_divergence(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Ünï", "ünï", "ABC", "abc", "中文", "x-y", "don't", "😀z"]
    rows = [(" ".join(words[int(r.random() ** 2 * len(words))] for _ in range(r.choice((0, 3, 40, 200)))), r.choice(("en", "de", None)), r.choice(("a", "b", "é", "Z", None))) for _ in range(120)]
    rows += [(None, "en", "nothing"), ("", "fr", "one"), ("alone", "it", "a"), ("alone", "it", "b"), (None, None, None), ("same text", "es", "a")] + [("same text", "es", "b")] * 3 + [(" ".join(words) * 300, "en", "a")]
    for top in (200, 4):
        docs = clashing(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4))
        assert Counter(tuple(x) for x in div.divergence(docs, top).collect()) == plain_divergence(rows, top)
    assert div.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    monkeypatch.setattr(div, "BLOCK", 50)
    text = ("word Mixed " * 40 + "ü" * 200).encode()
    known = defaultdict(lambda: len(known))
    assert np.concatenate(list(div._codes(text, known.__getitem__))).tolist() == [0, 1] * 40 + [2]


def test_groups_of_segments_with_one_and_with_more_cuts(spark):
    from fluxgrid.llm.alignment import align_segments

    rows = [(1, "ab", 1, [7], [8, 9], [3], [1, 2]), (2, "abc", 1, [1, 2, 3], [4, 5], [1, 1, 2], [2, 2])]
    out = align_segments(spark.createDataFrame(rows, "seg long, word string, n long, a array<int>, b array<int>, a_size array<short>, b_size array<short>"))
    assert {r["seg"]: r["groups"] for r in out.collect()} == {1: "7|8,9", 2: "1,2|4;3|5"}
    # A comparator of its own for each pair of places is not compiled.
    assert "array_sort" not in out._jdf.queryExecution().optimizedPlan().toString()
