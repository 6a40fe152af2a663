"""Exact copies, lines, shingle components and repeated spans against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from fixtures import clashing, corpus, stored, words

from fluxgrid.llm.exact_dedup import exact_dedup
from fluxgrid.llm.line_dedup import dedup_lines, line_report
from fluxgrid.llm.ngram_join import keep_one, ngram_components
from fluxgrid.llm.suffix_dedup import front_code, front_decode, merge_runs, suffix_dedup

ROWS = corpus()
LOW = -(1 << 63)


def order(row):
    return LOW if row[0] is None else row[0]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return stored(spark, ROWS, tmp_path_factory.mktemp("docs") / "t")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return stored(spark, [], tmp_path_factory.mktemp("none") / "t")


def test_exact(docs):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = {}
    for plain, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        for m in members:
            want[m[3]] = (best[3], len(members), m is best, hashlib.sha256(plain.encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in exact_dedup(clashing(docs), fan_in=2).collect()}
    assert got == want


def test_exact_keeps_one_of_repeated_rows(spark, tmp_path):
    twice = stored(spark, [(1, "a b"), (1, "a b"), (2, "ab")], tmp_path / "t")
    rows = exact_dedup(twice).collect()
    assert [r["group_size"] for r in rows] == [3] * 3 and sum(r["kept"] for r in rows) == 1


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = {order(r): shingles(r[1]) for r in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components(spark, tmp_path, seed):
    rows = corpus(seed)
    got = {LOW if r["doc_id"] is None else r["doc_id"]: (r["n_shingles"], LOW if r["component_id"] is None else r["component_id"]) for r in ngram_components(clashing(stored(spark, rows, tmp_path / "t"))).collect()}
    assert got == components(rows)


def test_keep_one(docs, spark, tmp_path):
    want = components(ROWS)
    kept = sorted(LOW if r["doc_id"] is None else r["doc_id"] for r in keep_one(clashing(docs)).collect())
    assert kept == sorted(i for i, (n, c) in want.items() if n == 0 or i == c)
    again = stored(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None)], tmp_path / "t")
    assert sorted(r["doc_id"] for r in keep_one(again).collect()) == [1, 2, 2]


def line_brute(rows):
    seen, out = [], {}
    index = defaultdict(list)
    for i, t in sorted(rows, key=order):
        lines, gone = (t or "").split("\n"), []
        for k, x in enumerate(lines):
            w = [u for u in re.split("[ \t\x0b\f\r]+", x) if u]
            if len(w) < 5:
                continue
            s = {tuple(w[a : a + 5]) for a in range(len(w) - 4)}
            shared = Counter(j for g in s for j in index[g])
            if any(7 * n >= 3 * (len(s) + len(seen[j])) for j, n in shared.items()):
                gone.append(k)
            for g in s:
                index[g].append(len(seen))
            seen.append(s)
        out[i] = (len(lines), gone, "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 3])
def test_lines(spark, tmp_path, seed):
    rows = corpus(seed)
    want = line_brute(rows)
    docs = stored(spark, rows, tmp_path / "t")
    got = {r["doc_id"]: (r["n_lines"], r["removed"], r["kept_sha256"]) for r in line_report(clashing(docs)).collect()}
    assert got == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in want.items()}
    texts = {r["doc_id"]: r["text"] for r in dedup_lines(clashing(docs)).collect()}
    assert texts == {i: (kept if gone else dict(rows)[i]) for i, (_, gone, kept) in want.items() if not gone or kept.strip(" ")}
    assert dedup_lines(clashing(docs)).columns == clashing(docs).columns


def test_short_lines(spark, tmp_path):
    rows = [(1, "Read more\nHome\none two three four five\n\n---"), (2, "Home\n  read more\nRead \tmore\nHome again"), (3, "Home\r\n\n \n---"), (None, "a b c d"), (4, "a b c d\na b c\na b c d e"), (5, "中文没有空格\n中文没有空格")]
    want = {None: [], 1: [], 2: [0, 2], 3: [0, 3], 4: [0], 5: [1]}
    docs = stored(spark, rows, tmp_path / "t")
    assert {r["doc_id"]: r["removed"] for r in line_report(docs, short_lines=True).collect()} == want
    texts = {r["doc_id"]: r["text"] for r in dedup_lines(docs, short_lines=True).collect()}
    assert texts[2] == "  read more\nHome again" and texts[4] == "a b c\na b c d e" and texts[5] == "中文没有空格"


def spans_brute(rows, span=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=order):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            w = raw[p : p + span]
            if w in seen:
                covered[p : p + span] = b"\1" * span
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        out[i] = (len(raw), sum(covered), sum(c and (k == 0 or not covered[k - 1]) for k, c in enumerate(covered)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 4])
def test_spans(spark, tmp_path, seed):
    rows = corpus(seed)
    got = {r[0]: tuple(r[1:5]) for r in suffix_dedup(clashing(stored(spark, rows, tmp_path / "t"))).collect()}
    assert got == spans_brute(rows)


def test_loser_tree_merges_front_coded_runs():
    suffixes = sorted(s.encode() for s in "ab abc abcd b ba ab abx zz a abcd".split())
    runs = []
    for k in range(3):
        run = suffixes[k::3]
        shared, sizes, tails = front_code(run)
        assert front_decode(shared, sizes, tails) == run
        runs.append((run, shared))
    merged = [(runs[r][0][i], n) for r, i, n in merge_runs(runs)]
    assert [s for s, _ in merged] == suffixes
    for (a, _), (b, n) in zip(merged, merged[1:], strict=False):
        assert n == len([1 for k in range(min(len(a), len(b))) if a[: k + 1] == b[: k + 1]])


@pytest.mark.parametrize("operator", [exact_dedup, ngram_components, line_report, suffix_dedup, dedup_lines, keep_one])
def test_empty(empty, operator):
    assert operator(empty).count() == 0


def test_lines_of_a_large_group(spark, tmp_path, monkeypatch):
    """Many edited copies of a few lines, in cells that are much smaller than the groups."""
    monkeypatch.setattr("fluxgrid.llm.line_dedup.CELL", 8)
    r = random.Random(5)
    base = [words(r, 24) for _ in range(3)]
    rows = []
    for i in range(150):
        w = list(base[i % 3])
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"e{r.randrange(40)}"
        rows.append((i // 2, " ".join(w) + ("\n" + " ".join(base[0]) if i % 25 == 24 else "")))
    rows = [(i, t) for i, t in dict(rows).items()]
    want = line_brute(rows)
    got = {x["doc_id"]: x["removed"] for x in line_report(stored(spark, rows, tmp_path / "t")).collect()}
    assert got == {i: gone for i, (_, gone, _) in want.items()}
    assert 5 < sum(not g for g in got.values()) < 70


def test_repeated_rows_and_tied_ids(spark, tmp_path):
    text = "\n".join(f"line {k} of a text that was stored several times" for k in range(3))
    rows = [(7, text), (7, text), (7, text), (None, text)]
    docs = stored(spark, rows, tmp_path / "t")
    lines = line_report(docs).collect()
    assert sorted(r["n_removed"] for r in lines) == [0, 3, 3, 3]
    assert [r["doc_id"] for r in lines if r["n_removed"] == 0] == [None]
    long = "passage " * 40
    spans = suffix_dedup(stored(spark, [(3, long + "x"), (3, long + "x"), (3, long + "y")], tmp_path / "u"))
    assert sum(r["n_removed"] == 0 for r in spans.collect()) == 0  # the first repeats itself


def test_lines_of_more_rows_than_a_broadcast_holds(spark, docs, monkeypatch):
    from fluxgrid.llm import common, line_dedup

    want = sorted(map(str, line_report(docs, short_lines=True).collect()))
    for bound, joins in ((8, 1), (0, 3)):
        monkeypatch.setattr(common, "BROADCAST_IDS", bound)
        monkeypatch.setattr(line_dedup, "BROADCAST_IDS", bound)
        report = line_report(docs, short_lines=True)
        plan = report._jdf.queryExecution().sparkPlan().toString()
        # Only the rows that lose lines meet them by a shuffle; the texts of the others stay where they are.
        assert plan.count("SortMergeJoin") == joins
        assert sorted(map(str, report.collect())) == want


def test_tables_of_finished_steps_go(spark, docs, monkeypatch):
    import os

    from fluxgrid.llm.common import Workspace

    write, held = Workspace.write, {}

    def listed(self, df, name):
        held[name] = set(os.listdir(self.root.removeprefix("file://"))) if held else set()
        return write(self, df, name)

    monkeypatch.setattr(Workspace, "write", listed)
    dedup_lines(docs, short_lines=True)
    assert not held["removed"] & {"lines", "shared", "wanted", "pairs-1", "pairs-2"}


def test_keys_are_shuffled_by_parts(spark, docs, monkeypatch):
    from fluxgrid.llm import common, line_dedup

    parts, broadcast, write, only = {}, [], common.Workspace.write, line_dedup.only_ids

    def noted(self, df, name):
        out = write(self, df, name)
        if name.startswith("shared"):
            parts[name] = {r["token"] % 3 for r in out.select("token").distinct().collect()}
        return out

    def counted(rows, ids, key, count):
        broadcast.append(count == ids.count())
        return only(rows, ids, key, count)

    want = sorted(map(str, line_report(docs).collect()))
    monkeypatch.setattr(line_dedup, "WAVES", 3)
    monkeypatch.setattr(common.Workspace, "write", noted)
    monkeypatch.setattr(line_dedup, "only_ids", counted)
    # Beyond the bound the sets are counted, not the pairs that they are in.
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", 0)
    assert sorted(map(str, line_report(docs).collect())) == want
    assert sorted(parts.values(), key=str) == [{0}, {1}, {2}] and broadcast and all(broadcast)
