"""Packing, token files and chat formatting against the tokenizers themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import clashing, corpus, stored, table
from tokenizers import Tokenizer

from fluxgrid.llm.chat_format import escape, format_chats, parse, read_back, unescape
from fluxgrid.llm.common import small_batches, tidy
from fluxgrid.llm.packing import binary_lengths, pack
from fluxgrid.llm.queries import tokenizer_path
from fluxgrid.llm.token_output import SequenceFile, read_tokens, write_tokens
from fluxgrid.llm.tokens import MARK, PieceEncoder, encoder

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a  b", "it's, he'll.", "x\n\ny \n z", "\t a\r\nb ", "été,  ÉTÉ. b", "中文 字, a.b,c", "12 345,6.7", f"a{MARK} b", "  x", "don't.", "a, b. c", "<|endoftext|> x", "\\ </s>"]


def ids(path, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_same_ids(path):
    texts = ODD + [t or "" for _, t in corpus()]
    encoder = PieceEncoder(path)
    for _ in range(2):  # from the cache as well
        for text, raw in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(raw, encoder.dtype).tolist() == ids(path, text), text


def test_packing(spark):
    rows = corpus()
    docs = clashing(table(spark, rows))
    pieces = pack(docs, WORD, end_id=1).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    for i, text in rows:
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        want = [*ids(WORD, text), 1]
        assert [x for p in mine for x in p["ids"]] == want
        assert [p["length"] for p in mine] == binary_lengths(len(want), 2048)
        assert all(p["offset"] == 0 and p["doc_tokens"] == len(want) and p["length"] == 1 << p["bucket"] for p in mine)
    sums = {(p["doc_id"], p["start"]): p["ids_crc32"] for p in pack(docs, WORD, end_id=1, digest=True).collect()}
    assert sums == {(p["doc_id"], p["start"]): zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in pieces}
    assert pack(table(spark, []), WORD, end_id=1).count() == 0
    with pytest.raises(ValueError):
        pack(docs, WORD, end_id=1, context=100)


def test_token_files(spark, tmp_path):
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0]))
    folder = f"file://{tmp_path}/tokens"
    index = write_tokens(clashing(table(spark, corpus())), folder, BYTE, end_id=0, seq_len=64)
    at, want = 0, {}
    for i, text in rows:
        x = [*ids(BYTE, text), 0]
        want[i] = (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert {r[0]: tuple(r[1:]) for r in read_tokens(spark, folder).collect()} == want
    name = index.first()["file"]
    part = index.where(index["file"] == name).orderBy("file_start").collect()
    file, size = SequenceFile(name), sum(r["n_tokens"] for r in part)
    first, mask = file.sequence(0)
    assert len(first) == len(mask) == 64 and first.tolist() == file.ids(0, 64).tolist()
    last, mask = file.sequence((size - 1) // 64)
    assert mask.sum() == (size - 1) % 64 + 1 and not last[mask.sum() :].any()
    write_tokens(table(spark, []), f"{folder}-none", BYTE, end_id=0)
    assert read_tokens(spark, f"{folder}-none").count() == 0


def test_escape_is_reversible():
    for t in ["", "\\", "\\\\<s>", "</s>[INST] ok [/INST]", "<|sep|><|end|>", "<<s>>", "[[INST]]", "<\\s>", "a\\[INST]\n", "<|a b|>", *ODD]:
        e = escape(t)
        assert unescape(e) == t
        assert not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|sep|>", "<|end|>", "<|start|>"))


@pytest.mark.parametrize("part", [4_000_000, 40])
def test_chats(spark, monkeypatch, part):
    monkeypatch.setattr("fluxgrid.llm.chat_format.PART", part)
    rows = [(1, 0, "user", "hi\\"), (1, 1, "assistant", " lead and trail "), (1, 2, "assistant", "!!<|end|>>"), (2, 1, "assistant", None), (2, 0, None, "é\n\n"), (3, 0, "system", "</s>[INST] ok [/INST]"), (3, 1, "assistant", "</s>[INST] ok [/INST]"), (None, None, "assistant", "x"), (4, 0, "user", "twice"), (4, 0, "user", "twice"), (5, 0, "assistant", "\U0001f600 中")]
    table_ = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    formatted = format_chats(table_, BYTE)
    turns, loss = {}, {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns[c] = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss[c] = "".join(r[3] or "" for r in mine if r[2] == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["conv_id"]: r for r in read_back(formatted).collect()}
    assert {c: (r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == {c: (sha(turns[c]), len(loss[c]), sha(loss[c])) for c in turns}
    if part > 1000:
        for r in formatted.collect():
            assert r["input_ids"] and len(r["input_ids"]) == len(r["loss_mask"]) == len(r["token_start"])
            assert "".join(f"{a}\n{b}\n" for a, b in parse(r["text"])) == turns[r["conv_id"]]
    assert read_back(format_chats(table_.where("false"), BYTE)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_of_odd_texts(name, monkeypatch):
    """Random mixes of spaces, signs and letters that change when lowered, in segments that cut most texts."""
    monkeypatch.setattr("fluxgrid.llm.tokens.SEGMENT", 40)
    r = random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\r\n", ".", ",", "'s", "é", "İ", "ﬁ", "שׁ", "\xa0", "　", "中", "23", "<|endoftext|>", "</w>", "x" * 70, "́", "ß", "\x0b", "\x85", "word", "WORD,"]
    texts = ["".join(r.choice(parts) + r.choice(("", " ")) for _ in range(r.randrange(30))) for _ in range(3000)]
    plain = Tokenizer.from_file(tokenizer_path(name))
    plain.encode_special_tokens = True
    words = PieceEncoder(tokenizer_path(name))
    want = [np.array(e.ids, words.dtype).tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert words.encode(texts) == want and words.encode(texts[::-1]) == want[::-1]


def test_other_operators_do_not_hold_the_cache():
    held = encoder(WORD)
    assert list(tidy(iter, keep=True)([1, 2])) == [1, 2]
    assert encoder(WORD) is held
    assert list(tidy(iter)([1, 2])) == [1, 2]
    assert encoder.cache_info().currsize == 0


def test_texts_come_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = table(spark, [(i, "x" * 3_000_000) for i in range(9)]).coalesce(1).select("text")
    try:
        small_batches(spark)
        sizes = [r["text"] for r in docs.mapInArrow(lambda batches: (b.from_pydict({"text": [str(b.num_rows)]}) for b in batches), "text string").collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(map(int, sizes)) == 9 and max(map(int, sizes)) <= 3
