"""Tokenization with the public tokenizer files, by pieces of text that repeat.

Both vocabularies split a text before they merge inside the pieces, so a text that is cut where the splitter always
cuts gives the same ids piece by piece. Pieces of a block of texts are found and told apart by hashes of whole buffers;
each distinct one is looked up once in a cache of bounded size, those not in it are encoded together, and the ids of all
pieces are gathered at once. Long texts are cut at such places too, so memory follows the block, not the text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa

from fluxgrid.llm.common import CACHES
from fluxgrid.llm.shingles import Bytes, words

#: Cached pieces of one Python worker: about 120 MB. Above half of that, a piece enters when it is seen in a second block.
CACHE = 500_000
#: Longer pieces are seldom seen twice.
PIECE = 48
#: A token of its own, from the private use area, between pieces that are encoded together.
MARK = ""

#: A single space between two visible characters: the byte-level splitter begins a piece there.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: White space but the space and the line feed.
#: Characters whose pieces are told apart together.
SEGMENT = 2_500_000
#: Words of Latin letters, which stay one piece when they are lowered.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
_RARE_SPACES = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))


class PieceEncoder:
    """encode(texts) gives the ids of each text as little-endian unsigned integers of 16 or 32 bits."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.lowers = self.tokenizer.normalizer is not None
        self.cache: dict[str, bytes] = {}
        self.room = CACHE
        self.bytes = Bytes("\n " if self.lowers else " ", fold=self.lowers)
        self.once = np.zeros(1 << 22, bool)
        self.signs = dict(zip(".,", self._one_by_one([".", ","]), strict=True))
        if self.lowers:
            self.tokenizer.add_tokens([AddedToken(MARK, normalized=False)])
            self.mark = self.tokenizer.token_to_id(MARK)
            vocabulary = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        else:
            # A byte-level vocabulary spells every byte as one character.
            vocabulary = self.tokenizer.get_vocab()
            self.n_bytes = np.zeros(max(vocabulary.values()) + 1, "i8")
            self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def _odd(self, text: str) -> bool:
        """Whether the text has white space besides line feeds and single spaces between visible characters."""
        if self.lowers:
            return False
        rare = _RARE_SPACES[: None if not text.isascii() else 8]
        return "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in rare)

    def _split_odd(self, text: str) -> list[str]:
        """Pieces whose ids, one after the other, are those of the text. A piece stands for itself behind a space; with a
        space at its end, for itself without that space."""
        return [p[1:] if p[0] == " " and p[1:] and p[-1] != " " else p + " " for p in _BEFORE_SPACE.split(text) if p]

    def _source(self, piece: str) -> str:
        if self.lowers:
            return piece
        return piece[:-1] if piece[-1:] == " " else " " + piece

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        tokenizer = self.tokenizer
        if any(MARK in t for t in texts):
            tokenizer = type(tokenizer).from_file(self.path)
            tokenizer.encode_special_tokens = True
        return [np.array(e.ids, self.dtype).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _between_marks(self, texts: list[str]) -> list[bytes]:
        width, joined = self.dtype.itemsize, "".join([t + MARK for t in texts])
        if joined.count(MARK) != len(texts):
            return self._one_by_one(texts)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
        ends = (np.flatnonzero(ids == self.mark) * width).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(e + width for e in ends[:-1])], ends, strict=True)]

    def _between_spaces(self, texts: list[str]) -> list[bytes]:
        """Words of letters only: each ends with its one token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, self.dtype)
        cut = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(cut) != len(texts):
            return self._between_marks(texts)
        raw, width = ids.tobytes(), self.dtype.itemsize
        return [raw[width * a : width * b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def _end_to_end(self, texts: list[str]) -> list[bytes]:
        """Pieces that begin with a space and end with a visible character: their ids tile the bytes of the joined text."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.cumsum(self.n_bytes[ids])
        cut = np.searchsorted(ends, np.cumsum([len(t.encode()) for t in texts])) + 1
        raw, at = ids.tobytes(), (cut * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def _ids(self, pieces: list[str]) -> dict[str, bytes]:
        if self.lowers:
            latin, others = [], []
            for p in pieces:
                (latin if p.isascii() and p.isalpha() or _LATIN.fullmatch(p) else others).append(p)
            out = dict(zip(latin, self._between_spaces(latin), strict=True)) if latin else {}
            return out | dict(zip(others, self._between_marks(others), strict=True)) if others else out
        odd = [p for p in pieces if p == "" or p[-1].isspace()]
        plain = [p for p in pieces if p != "" and not p[-1].isspace()]
        out = dict(zip(odd, self._one_by_one([self._source(p) for p in odd]), strict=True)) if odd else {}
        return out | dict(zip(plain, self._end_to_end([" " + p for p in plain]), strict=True)) if plain else out

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, from the cache or encoded now."""
        cache = self.cache
        out = list(map(cache.get, pieces))
        lacking = [i for i, v in enumerate(out) if v is None]
        missing = {pieces[i] for i in lacking}
        # A letter and a sign behind it are never merged: such a piece is made of its word and the sign.
        signed = [p for p in missing if p[-1:] in self.signs and _LATIN.fullmatch(p[-2:-1])]
        missing.difference_update(signed)
        missing.update([p[:-1] for p in signed if p[:-1] not in cache])
        todo, new = list(missing), {}
        for start in range(0, len(todo), 10_000):
            new |= self._ids(todo[start : start + 10_000])
        for p in signed:
            word = p[:-1]
            new[p] = (new[word] if word in new else cache[word]) + self.signs[p[-1]]
        for i in lacking:
            out[i] = new[pieces[i]]
        if len(cache) > self.room // 2:
            names = list(new)
            slots = np.fromiter(map(hash, names), "i8", len(names)) & (len(self.once) - 1)
            again = self.once[slots] & (len(cache) < self.room)
            self.once[slots] = True
            cache.update((p, new[p]) for p, seen in zip(names, again.tolist(), strict=True) if seen and len(p) <= PIECE)
        else:
            cache.update((p, v) for p, v in new.items() if len(p) <= PIECE)
        return out

    def _encode_plain(self, texts: list[str], starts: list[bool]) -> list[bytes]:
        """The ids of texts without odd white space; starts: whether each begins its document, or else behind a space."""
        raw = [t.encode() for t in texts]
        data, offsets = b"".join(raw), np.array([0, *accumulate(map(len, raw))])
        hashes, begin, end, first = words(np.frombuffer(data, "u1"), offsets, tables=self.bytes)
        if len(hashes) == 0:
            return [b""] * len(texts)
        leads = np.zeros(len(hashes), bool)
        if not self.lowers:  # there, a piece at the beginning has no space before it
            leads[first[:-1][np.array(starts) & (np.diff(first) > 0)]] = True
            hashes = hashes ^ np.where(leads, ~np.uint64(0), np.uint64(0))
        coded = pa.array(hashes).dictionary_encode()
        code = coded.indices.to_numpy()
        at = np.empty(len(coded.dictionary), "i8")
        at[code] = np.arange(len(code))  # any place of each distinct piece
        pieces = [data[a:b].decode() for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
        if not self.lowers:
            pieces = [p + " " if lead else p for p, lead in zip(pieces, leads[at].tolist(), strict=True)]
        ids = self._look_up(pieces)
        size = np.fromiter(map(len, ids), "i8", len(ids)) // self.dtype.itemsize
        pool, origin = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(size) - size
        each = size[code]
        ends = np.cumsum(each)
        taken = pool[np.repeat(origin[code] - (ends - each), each) + np.arange(ends[-1])].tobytes()
        cuts = (np.append(0, ends)[first] * self.dtype.itemsize).tolist()
        return [taken[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, str, bool]] = []
        room = SEGMENT

        def flush() -> None:
            for (i, _, _), ids in zip(group, self._encode_plain([g[1] for g in group], [g[2] for g in group]), strict=True):
                out[i].append(ids)
            group.clear()

        for i, text in enumerate(texts):
            if self._odd(text):
                pieces = self._split_odd(text)
                known = list(dict.fromkeys(pieces))
                ids = dict(zip(known, self._look_up(known), strict=True))
                out[i].append(b"".join(map(ids.__getitem__, pieces)))
                continue
            start = 0
            while start < len(text):
                end = len(text) if len(text) - start <= SEGMENT else text.find(" ", start + SEGMENT)
                end = len(text) if end < 0 else end
                group.append((i, text[start:end], start == 0))
                room -= end - start
                if room <= 0:
                    flush()
                    room = SEGMENT
                start = end + 1  # the space is part of the next piece, or dropped
        if group:
            flush()
        return [b"".join(x) for x in out]


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder, and so one cache, for each file and Python worker."""
    return PieceEncoder(path)


CACHES.append(encoder.cache_clear)


def blocks(texts, chars: int = 4_000_000):
    """Slices of a list of texts of about so many characters: (start, end)."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
