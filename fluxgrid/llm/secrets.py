"""Secret scan with a random forest that removes false positives.

Every white-space separated word gives candidates: the word itself without quotes and signs around it, an assignment
(`password=...`, `key: ...`) split into a name and a value, and, where it holds separators, every further assignment and
every token run inside (JSON, query strings, paths), and the password in an address of a host. The forest sees the value's length, character classes and
transitions, distinct characters, the share covered by a small dictionary of common syllables, its path signs, the name
and the two words before.

Plain words (lower case, capitalised, capitals or letters without case; no name or assignment before) are left out of the scan up to the length, by kind, at which
the largest score that the forest can give to any of them, over all that is not known of them, is below the threshold.
So that never changes a finding. Rows are all secrets, and of the harmless candidates those that are whole words of 12 characters or
more with a digit. A pass phrase of several words is judged word by word.

The forest is trained here, on labelled findings: a table of (text, label) whose texts hold one candidate each. Without
one, `labelled_findings` and `word_findings` make them from formats of keys, tokens and passwords and of harmless look-alikes (card and
phone numbers, addresses, hashes of commits, identifiers, paths, glued words). Its trees become one table of nodes, walked by
array functions, so the scan runs in DataFrame expressions alone; the driver trains on a few thousand findings, whatever the size of `docs`.

Null texts count as empty. Repeated rows are scanned once each, null doc_ids stay null. Extra columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import json
import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm.common import text_of

#: Harmless candidates are reported from this length of the word and of the value; what is a secret does not depend on it.
LEAST_LENGTH, LEAST_VALUE, THRESHOLD = 12, 8, 0.5
# Words that name secrets, words that name harmless values, known beginnings, common syllables.
SECRET_NAMES = "token|secret|password|passwd|pwd|passphrase|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|key"
PLAIN_NAMES = "commit|sha|sha1|sha256|md5|hash|digest|checksum|uuid|guid|id|isbn|issn|doi|version|build|ref|revision|phone|tel|card|iban|order|invoice"
KNOWN = "akia|asia|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abp]-|aiza|eyj|ya29"
LOUD = ("key", "token", "secret", "passw", "passphrase", "pwd", "auth", "bearer", "credential")
SYLLABLES = "tion|ment|ing|the|and|ous|able|ible|ness|ence|ance|eaux|eau|que|aire|elle|ung|heit|keit|lich|isch|sch|ein|ver|ción|mente|ado|ida|ist|ter|ent|est|ion|ere|and|her|ate|ain|our|ear|ons|ers|ity|ive|ful|pro|con|com|pre|dis|ist|age|ies|ard|ght"

FEATURES = ("length", "digits", "upper", "lower", "hex", "runs", "distinct", "syllables", "slashes", "dots", "at", "dashes", "known", "secret_name", "plain_name", "assigned", "secret_near", "plain_near", "quoted")


def _share(value: Column, removed: str) -> Column:
    return 1 - F.length(F.regexp_replace(value, removed, "")) / F.greatest(F.length(value), F.lit(1))


#: Signs between the pieces of a word; paths, hosts and assignments are split further into token runs.
PIECES, RUNS = r"[\"'`{}\[\]()<>,;&?|]+", r"[\"'`{}\[\]()<>,;&?|/\\\\@=:]+"
#: The password in the address of a host.
ADDRESS = r"://[^/@:]*:([^/@]+)@"
#: A name and a value, without the signs around them.
PATTERN = r"^[^\p{L}\p{N}]*(?:([\p{L}_][\p{L}\p{N}_.-]*)[\"']?(?:=|:(?!//))[\"']?)?[^\p{L}\p{N}/+]*(.*?)[^\p{L}\p{N}/+=]*$"
_AROUND = r"[^\p{L}\p{N}\"'`/+=:\\\\@]*"
_FLAT = dict.fromkeys(("digits", "slashes", "dots", "at", "dashes", "known", "secret_name", "plain_name", "assigned", "secret_near", "quoted"), (0.0, 0.0))


#: Kinds of plain words: the pattern of one with n letters at most, and what is known of its features at n letters.
#: Marks that are no letters are in none of them, and letters without case in one of their own.
_RUNS_OF_ONE = {"runs": lambda n: (1 / n, 1 / n)}
_ANY_RUNS = {"runs": lambda n: (1 / n, 1.0)}
KINDS = {
    "ascii": (r"[a-z]|[A-Za-z][a-z]{{1,{more}}}", {"upper": lambda n: (0.0, 1 / n if n > 1 else 0.0), "lower": lambda n: ((n - 1) / n if n > 1 else 1.0, 1.0), "runs": lambda n: (1 / n, min(2, n) / n)}),
    "ascii capitals": (r"[A-Z]{{1,{n}}}", {"upper": lambda n: (1.0, 1.0), "lower": lambda n: (0.0, 0.0)} | _RUNS_OF_ONE),
    "lower case": (r"\p{{Ll}}{{1,{n}}}", {"upper": lambda n: (0.0, 0.0), "lower": lambda n: (1.0, 1.0)} | _ANY_RUNS),
    "capitalised": (r"\p{{Lu}}\p{{Ll}}{{0,{more}}}", {"upper": lambda n: (1 / n, 1 / n), "lower": lambda n: ((n - 1) / n, (n - 1) / n)} | _ANY_RUNS),
    "capitals": (r"\p{{Lu}}{{1,{n}}}", {"upper": lambda n: (1.0, 1.0), "lower": lambda n: (0.0, 0.0)} | _ANY_RUNS),
    "without case": (r"\p{{Lo}}{{1,{n}}}", {"upper": lambda n: (0.0, 0.0), "lower": lambda n: (0.0, 0.0)} | _ANY_RUNS),
}
#: Around rounding of shares, on both sides.
_SLACK = 1e-9


def plain_words(longest: dict[str, int]) -> str:
    """Words without a letter or number, and words of the kinds in `longest`, up to their lengths."""
    kinds = "|".join(KINDS[k][0].format(n=n, more=max(n - 1, 0) or 1) for k, n in longest.items() if n >= 2)
    return rf"^{_AROUND}(?:(?!(?iu:{KNOWN}))(?:{kinds}))?{_AROUND}$" if kinds else rf"^{_AROUND}$"


def plain_box(kind: str, n: int) -> dict[str, tuple[float, float]]:
    """Least and most of the features of plain words of n letters, unless a name or an assignment stands before them."""
    box = _FLAT | {"length": (n, n)} | {f: of(n) for f, of in KINDS[kind][1].items()}
    return {f: (low - _SLACK, high + _SLACK) for f, (low, high) in box.items()}


def _loud(word: Column) -> Column:
    """Whether the two words after this one may have a name or an assignment before them: of the names, each holds one of these parts."""
    low = F.lower(word)
    found = word.endswith("=") | word.endswith(":")
    for part in LOUD:
        found = found | low.contains(part)
    return found


def _found(word: Column) -> Column:
    """(name, value, whole) of the candidates in a word, each value once."""
    split = lambda w, whole: F.struct(F.regexp_extract(w, PATTERN, 1).alias("name"), F.regexp_extract(w, PATTERN, 2).alias("value"), F.lit(whole).alias("whole"))
    # Quotes beside = and : go, and of a chain like a=b:c=d each assignment is a piece.
    joined = F.regexp_replace(word, "[\"'`]?([=:])[\"'`]?", "$1")
    pieces = F.split(joined, rf"{PIECES}|[=:](?=[\p{{L}}_][\p{{L}}\p{{N}}_.-]*(?:=|:(?!//)))")
    inner = F.concat(F.transform(pieces, lambda w: split(w, False)), F.transform(F.split(word, RUNS), lambda w: split(w, False)))
    whole = F.array(split(word, True))
    # In user:password@host after a scheme, the second part is named by its place.
    address = F.array(F.struct(F.lit("password").alias("name"), F.regexp_extract(word, ADDRESS, 1).alias("value"), F.lit(False).alias("whole")))
    every = F.when(word.rlike(RUNS), F.concat(whole, inner, address)).otherwise(whole)
    # Of equal values, the first with a name stays, else the first.
    better = F.array_sort(every, lambda a, b: F.when(a["name"] == b["name"], 0).when(a["name"] == "", 1).when(b["name"] == "", -1).otherwise(0))
    first = F.aggregate(better, F.filter(better, lambda x: F.lit(False)), lambda done, x: F.when((x["value"] == "") | F.exists(done, lambda y: y["value"] == x["value"]), done).otherwise(F.concat(done, F.array(x))))
    return F.when(word.rlike(RUNS), first).otherwise(F.filter(whole, lambda x: x["value"] != ""))


def candidates(docs: DataFrame, *keep: str, longest: dict[str, int] | None = None) -> DataFrame:
    """place (of the word), name, value, listed (a long whole word with a digit) and x, the features, of every candidate,
    beside the columns in `keep`; not of plain words of the kinds in `longest`, up to their lengths (from 2), that no name
    or assignment stands before."""
    words = F.filter(F.split(text_of(docs), r"\s+"), lambda w: w != "")
    rows = docs.select(*keep, words.alias("w")).where(F.size("w") > 0)
    at = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    places = F.sequence(F.lit(0), F.size("w") - 1)
    if longest:
        rows = rows.withColumn("loud", F.transform("w", _loud))
        loud = lambda i: F.coalesce(F.get("loud", i), F.lit(False))
        places = F.filter(places, lambda i: ~at(i).rlike(plain_words(longest)) | loud(i - 1) | loud(i - 2))
    made = F.transform(places, lambda i: F.struct(i.alias("place"), at(i).alias("word"), F.lower(F.concat_ws(" ", at(i - 2), at(i - 1))).alias("near")))
    rows = rows.select(*keep, F.explode(made).alias("c")).select(*keep, "c.*")
    rows = rows.select("*", F.explode(_found(F.col("word"))).alias("f")).select("*", "f.name", "f.value")
    listed = F.col("f.whole") & (F.length("word") >= LEAST_LENGTH) & (F.length("value") >= LEAST_VALUE) & F.col("value").rlike("[0-9]")
    v, low, n = F.col("value"), F.lower("value"), F.length("value")
    classes = F.translate(v, string.ascii_uppercase + string.ascii_lowercase + string.digits, "U" * 26 + "L" * 26 + "D" * 10)
    flag = lambda c: c.cast("double")
    feature = {
        "length": n.cast("double"), "digits": _share(v, "[0-9]"), "upper": _share(v, r"\p{Lu}"), "lower": _share(v, r"\p{Ll}"), "hex": _share(v, "[0-9a-fA-F]"),
        "runs": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / n, "distinct": F.size(F.array_distinct(F.split(v, ""))) / n, "syllables": _share(low, SYLLABLES),
        "slashes": _share(v, "[/\\\\]") * n, "dots": _share(v, r"\.") * n, "at": flag(v.contains("@")), "dashes": _share(v, "[-_:]") * n, "known": flag(low.rlike(f"^(?:{KNOWN})")),
        "secret_name": flag(F.lower("name").rlike(f"(?:{SECRET_NAMES})$")), "plain_name": flag(F.lower("name").rlike(f"(?:^|[_.-])(?:{PLAIN_NAMES})$")), "assigned": flag((F.col("name") != "") | F.col("near").rlike("[=:]$")),
        "secret_near": flag(F.col("near").rlike(f"\\b(?:{SECRET_NAMES})\\b")), "plain_near": flag(F.col("near").rlike(f"\\b(?:{PLAIN_NAMES})\\b")), "quoted": flag(F.col("word").rlike("[\"'`]")),
    }
    # A generated row: what reads the features, filters too, is not folded into their expressions.
    made = F.explode(F.array(F.struct(listed.alias("listed"), F.array(*(feature[f] for f in FEATURES)).alias("x"))))
    return rows.select(*keep, "place", "name", "value", made.alias("made")).select(*keep, "place", "name", "value", "made.*")


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """n texts of one candidate each, and whether it is a secret."""
    r = random.Random(seed)
    of = lambda chars, k: "".join(r.choices(chars, k=k))
    hexes, alnum, base64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = ["tion", "the", "an", "ou", "eau", "er", "ung", "sch", "que", "ado", "mi", "re", "st", "nd", "ing"]
    word = lambda k: "".join(r.choices(syllables, k=k))
    names = ["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth", "private_key", "client_secret", "PASSWORD", "TOKEN"]
    number = lambda k: of(string.digits, k)
    uuid = lambda: "-".join(of(hexes, k) for k in (8, 4, 4, 4, 12))
    secret = [
        lambda: "AKIA" + of(string.ascii_uppercase + "234567", 16), lambda: f'{r.choice(names)} = "{of(hexes, r.choice((32, 40, 64)))}"', lambda: f"{r.choice(names)}={of(hexes, r.randint(14, 40))}",
        lambda: f"{r.choice(names)}: {of(alnum, r.randint(16, 48))}", lambda: "ghp_" + of(alnum, 36), lambda: "sk-" + of(alnum, 40), lambda: f"xoxb-{number(11)}-{of(alnum, 24)}",
        lambda: f"bearer {of(base64, r.randint(30, 60))}", lambda: "eyJ" + of(alnum, 30) + "." + of(alnum, 40), lambda: f"{r.choice(names)}={of(alnum + '!#%&*', r.randint(12, 24))}7",
    ]
    plain = [
        lambda: number(16), lambda: f"+1({number(3)}){number(3)}-{number(4)}", lambda: ".".join(str(r.randint(100, 255)) for _ in range(4)), lambda: f"{word(3)}.{number(2)}@mail{number(1)}.example.com",
        lambda: f"commit {of(hexes, 40)}", lambda: f"md5 {of(hexes, 32)}", lambda: f"sha256: {of(hexes, 64)}", lambda: uuid(), lambda: f"id={uuid()}", lambda: f"https://{word(3)}.example/{word(2)}/{number(4)}/{word(3)}.html",
        lambda: f"/usr/{word(2)}/{word(3)}{number(2)}.txt", lambda: word(5) + number(2), lambda: f"{number(4)}-{number(2)}-{number(2)}T{number(2)}:{number(2)}:{number(2)}", lambda: f"ISBN {number(13)}", lambda: f"version {number(2)}.{number(3)}.{number(4)}-{word(1)}",
        lambda: word(4).upper() + number(1) + "!!", lambda: f"{word(3)}={word(3)}{number(1)}", lambda: f"order {number(12)}", lambda: f"{word(2)}_{word(2)}_{number(3)}", lambda: f"${number(3)},{number(3)},{number(3)}.{number(2)}",
    ]
    out = []
    for k in range(n):
        label = k % 2
        made = (secret if label else plain)[(k // 2) % len(secret if label else plain)]()
        out.append((f"{word(2)} {word(3)} {made}{r.choice(['', '', '.', ',', '***', '###'])} {word(2)}", label))
    return out


def word_findings(n: int = 4000, seed: int = 12) -> list[tuple[str, int, str]]:
    """n texts, whether a value in them is a secret, and that value: secrets without digits, short ones, those behind other
    assignments, and ordinary words. All else in these texts is harmless."""
    r = random.Random(seed)
    of = lambda chars, k: "".join(r.choices(chars, k=k))
    syllables = ["tion", "the", "an", "ou", "eau", "er", "ung", "sch", "que", "ado", "mi", "re", "st", "nd", "ing", "lo", "pa", "hu", "t", "s", "ba", "k"]
    word = lambda k: "".join(r.choices(syllables, k=k))
    names = ["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth", "private_key", "client_secret", "PASSWORD", "TOKEN", "pwd"]
    alnum = string.ascii_letters + string.digits
    some = lambda: r.choice((of(string.ascii_letters, r.randint(10, 32)), of(alnum, r.randint(8, 32)), word(2) + of(string.digits, 2), word(3) + of(string.digits, 2)))
    secret = [
        lambda _: ("{}", "AKIA" + of(string.ascii_uppercase, 16)), lambda v: (f"{r.choice(names)}={{}}", v), lambda v: (f"{r.choice(names)}: {{}}", v), lambda v: (f'{r.choice(names)} = "{{}}"', v),
        lambda v: (f'{{{{"user":"{word(1)}","{r.choice(names)}":"{{}}"}}}}', v), lambda v: (f"https://{word(2)}.example/{word(1)}?id={of(string.digits, 2)}&{r.choice(names)}={{}}", v),
        lambda v: (f"{r.choice(names)}={{}}", "-".join(word(2) for _ in range(4))), lambda v: (f"user={word(1)};{r.choice(names)}={{}}", v),
        lambda v: (f"{word(1)}://{word(2)}:{{}}@{word(2)}.example/{word(1)}", v), lambda _: (f'{r.choice(names)} {r.choice(("=", ":"))} "{{}}"', word(r.randint(5, 8))), lambda _: (f'{r.choice(names)}="{{}}"', word(r.randint(5, 8))),
        lambda _: (f"-----BEGIN {r.choice(('RSA ', 'EC ', ''))}PRIVATE KEY----- {{}}", of(alnum + "+/", 64)),
    ]
    plain = [
        lambda: ("{}", word(r.randint(1, 4))), lambda: ("{}", word(r.randint(1, 4)).capitalize()), lambda: ("{}", word(r.randint(1, 4)).upper()), lambda: (f"{r.choice(names)} {{}}", word(r.randint(1, 3))),
        lambda: (f"{r.choice(names)}: {{}}", word(r.randint(1, 3))), lambda: (f"{word(2)}: {{}}", word(r.randint(1, 4))), lambda: ("{}", "-".join(word(2) for _ in range(r.randint(2, 4)))), lambda: ("l'{}", word(2)),
        lambda: ("{}", of(string.digits, r.randint(1, 8))), lambda: ("{}", of(string.ascii_letters, r.randint(1, 3))), lambda: (f"https://{word(2)}.example/{{}}/", word(2) + of(string.digits, 2)), lambda: ("{}", word(2) + of(string.digits, 2)),
        lambda: ("{}", word(2).capitalize() + word(2).capitalize()), lambda: (f'{{{{"{word(2)}":"{{}}"}}}}', word(2)), lambda: (f"{word(1)}={{}}", word(2) + of(string.digits, 2)), lambda: ("{}", r.choice(names)), lambda: ("{}", f"{word(1)}_{word(2)}"),
        lambda: ("{}", of("0123456789abcdef", r.choice((8, 12)))), lambda: (f"{r.choice(names)}: {{}}", of(string.digits, r.randint(1, 3))),
    ]
    out = []
    for k in range(n):
        label = k % 2
        if label:
            frame, value = secret[(k // 2) % len(secret)](some())
        else:
            frame, value = plain[(k // 2) % len(plain)]()
        out.append((f"{word(2)} {word(3)} {frame.format(value)}{r.choice(['', '', '.', ','])} {word(2)}", label, value))
    return out


@dataclass
class Tree:
    """A split on `feature` below `at` (yes, no), or a leaf of `value`."""

    value: float
    feature: int = -1
    at: float = 0.0
    yes: "Tree | None" = None
    no: "Tree | None" = None

    def most(self, box: dict[str, tuple[float, float]]) -> float:
        """The largest value in a box of features (least, most); features that are not in it are free."""
        if self.feature < 0:
            return self.value
        low, high = box.get(FEATURES[self.feature], (-np.inf, np.inf))
        return max([self.yes.most(box)] * (low < self.at) + [self.no.most(box)] * (high >= self.at))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] < self.at, self.yes.score(x), self.no.score(x))


def _grow(x: np.ndarray, y: np.ndarray, depth: int, r: np.random.Generator, tried: int) -> Tree:
    p = float(y.mean())
    if depth == 0 or len(y) < 8 or p in (0.0, 1.0):
        return Tree(p)
    best = (p * (1 - p) - 1e-9, -1, 0.0)
    for f in r.choice(x.shape[1], tried, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if len(cut) == 0:
            continue
        left, right = s[cut - 1] / cut, (s[-1] - s[cut - 1]) / (len(y) - cut)
        impure = (cut * left * (1 - left) + (len(y) - cut) * right * (1 - right)) / len(y)
        k = int(impure.argmin())
        if impure[k] < best[0]:
            best = (float(impure[k]), int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
    _, f, at = best
    if f < 0:
        return Tree(p)
    low = x[:, f] < at
    return Tree(p, f, at, _grow(x[low], y[low], depth - 1, r, tried), _grow(x[~low], y[~low], depth - 1, r, tried))


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, seed: int = 5) -> list[Tree]:
    r = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = r.integers(0, len(y), len(y))
        forest.append(_grow(x[rows], y[rows].astype(float), depth, r, 6))
    return forest


def training_table(spark: SparkSession, findings: list[tuple]) -> DataFrame:
    """(text, label, value) of findings with or without a value."""
    rows = json.dumps([dict(zip(("text", "label", "value"), f, strict=False)) for f in findings])
    return spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<text:string,label:int,value:string>>")).alias("r")).select("r.*")


def fit(findings: DataFrame) -> list[Tree]:
    """A forest from labelled findings (text, label); a bounded table by its nature. Where a column `value` names the one
    that is meant, the other candidates of the text are harmless; without it the long words with a digit are meant, or the
    longest value."""
    value = findings["value"] if "value" in findings.columns else F.lit(None).cast("string")
    named = findings.where(F.col("label").isNotNull()).select("text", "label", value.alias("meant"), F.monotonically_increasing_id().alias("row"))
    texts: dict[int, list] = {}
    for c in candidates(named, "row", "label", "meant").collect():
        texts.setdefault(c["row"], []).append(c)
    data = []
    for found in texts.values():
        if found[0]["meant"] is not None:
            data += [(float(c["label"]) if c["value"] == c["meant"] else 0.0, *c["x"]) for c in found]
        else:
            longest = max(len(c["value"]) for c in found)
            meant = [c for c in found if c["listed"]] or [c for c in found if len(c["value"]) == longest][:1]
            data += [(float(c["label"]), *c["x"]) for c in meant]
    table = np.array(sorted(data)).reshape(-1, 1 + len(FEATURES))
    return train_forest(table[:, 1:], table[:, 0]) if len(table) else [Tree(0.0)]


def forest_score(forest: list[Tree], x: Column) -> Column:
    """The mean of the trees at the features x. The forest is one table of nodes (feature, at, yes, no, value), which the
    trees are walked in step by step; a leaf leads to itself."""
    nodes, roots = [], []

    def add(tree: Tree) -> int:
        k = len(nodes)
        nodes.append([0, 0.0, k, k, tree.value])
        if tree.feature >= 0:
            nodes[k] = [tree.feature, tree.at, add(tree.yes), add(tree.no), tree.value]
        return k

    def depth(tree: Tree) -> int:
        return 0 if tree.feature < 0 else 1 + max(depth(tree.yes), depth(tree.no))

    roots = [add(t) for t in forest]
    feature, at, yes, no, value = (F.lit(list(column)) for column in zip(*nodes, strict=True))
    leaf = F.lit(roots)
    for _ in range(max(depth(t) for t in forest)):
        leaf = F.transform(leaf, lambda n: F.when(F.get(x, F.get(feature, n)) < F.get(at, n), F.get(yes, n)).otherwise(F.get(no, n)))
    return F.aggregate(leaf, F.lit(0.0), lambda done, n: done + F.get(value, n)) / len(forest)


def longest_harmless(forest: list[Tree], threshold: float, most: int = 40) -> dict[str, int]:
    """For each kind, the length up to which no plain word can reach the threshold."""
    safe = lambda kind, n: sum(t.most(plain_box(kind, n)) for t in forest) / len(forest) < threshold - 1e-6
    return {kind: next((n - 1 for n in range(1, most + 1) if not safe(kind, n)), most) for kind in KINDS}


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, place, name, value_sha256, n_chars, score and secret (score >= threshold) of every secret, and of every
    harmless long word with a digit."""
    forest = fit(training_table(docs.sparkSession, labelled_findings() + word_findings()) if findings is None else findings)
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found = candidates(ids, "doc_id", longest=longest_harmless(forest, threshold))
    score = F.explode(F.array(F.round(forest_score(forest, F.col("x")), 9)))
    scored = found.select("doc_id", "place", "name", "value", "listed", score.alias("score")).where(F.col("listed") | (F.col("score") >= threshold))
    return scored.select("doc_id", "place", "name", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.length("value").alias("n_chars"), "score", (F.col("score") >= threshold).alias("secret"))
