"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of its assistant turns are
intersected with the token spans by binary search. A turn is rendered as

    <|start|>role<|sep|>text<|end|>

The three marks are tokens of their own, so no token crosses the border of a turn. Roles and texts are escaped: a
backslash is doubled, and a control string (CONTROL) gets a backslash after its first character; unescape() undoes both.

Turns are ordered by turn (null first), then role, then text; repeated rows are kept. Null roles and texts count as
empty, rows without conv_id form one conversation with a null conv_id, and only the role "assistant" bears loss. Rows
are sorted on disk and streamed; a conversation of more than PART characters is emitted in parts that end between turns
(part 0, 1, ...), each encoded by itself, which gives the same ids because the marks separate the text. Extra columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
CONTROL = r"</?s>|\[/?INST\]|<\|[^|<>\s]*\|>"
PART = 4_000_000
SCHEMA = "conv_id long, part int, text string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"

_TO_ESCAPE = re.compile(rf"\\|{CONTROL}")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(rf"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}" if len(m[0]) > 1 else "\\\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a rendered conversation."""
    return ((unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text))


@lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_tokens([AddedToken(x, normalized=False) for x in (START, SEP, END)])
    t.encode_special_tokens = True
    return t


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that overlap one of the sorted, disjoint spans."""
    mask = np.zeros(len(starts) + 1, "i4")
    if spans:
        a, b = np.array(spans).T
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        some = last > first
        np.add.at(mask, first[some], 1)
        np.add.at(mask, last[some], -1)
    return np.cumsum(mask[:-1]) > 0


def masked_text(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> Iterator[str]:
    """The text under each run of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype("i1"), [0]])))
    for lo, hi in edge.reshape(-1, 2):
        yield text[starts[lo] : ends[hi - 1]]


def _render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        at += len(head)
        if role == "assistant" and body:
            spans.append((at, at + len(body)))
        parts += [head, body, END]
        at += len(body) + len(END)
    return "".join(parts), spans


def format_chats(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each conversation (or part of a very long one): SCHEMA. Offsets are code points of `text`."""

    def emit(done: list[tuple[int | None, int, list]]) -> pa.RecordBatch:
        rendered = [_render(turns) for _, _, turns in done]
        cols: list[list] = [[], [], [], []]
        for (text, spans), e in zip(rendered, chat_tokenizer(tokenizer).encode_batch([t for t, _ in rendered], add_special_tokens=False), strict=True):
            offsets = np.array(e.offsets, dtype="i4").reshape(-1, 2)
            starts, ends = offsets[:, 0], offsets[:, 1]
            for to, x in zip(cols, (np.array(e.ids, "i4"), starts, ends, token_mask(starts, ends, spans)), strict=True):
                to.append(x)
        ints, bools = pa.list_(pa.int32()), pa.list_(pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _, _ in done], pa.int64()), pa.array([p for _, p, _ in done], pa.int32()), pa.array([t for t, _ in rendered]), *(pa.array(c, ints) for c in cols[:3]), pa.array(cols[3], bools)],
            names=["conv_id", "part", "text", "input_ids", "token_start", "token_end", "loss_mask"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, turns, conv, part, chars, held, open_ = [], [], None, 0, 0, 0, False
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if open_ and (c != conv or chars > PART):
                    done.append((conv, part, turns))
                    held += chars
                    part, turns, chars = (part + 1 if c == conv else 0), [], 0
                    if held > PART:
                        yield emit(done)
                        done, held = [], 0
                conv, open_ = c, True
                turns.append((role, text))
                chars += len(role) + len(text) + 32
        if open_:
            yield emit([*done, (conv, part, turns)])

    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), F.coalesce(c["role"], F.lit("")).alias("role"), F.coalesce(c["text"], F.lit("")).alias("text"), c["turn"].alias("turn"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from the rendered text, the offsets and the mask alone. Parts must follow
    each other in their partition, as format_chats leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, state, conv = [], None, None

        def end() -> None:
            if state:
                rows.append((conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["tokens"]))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])

        for batch in batches:
            convs, parts, texts = (batch.column(i).to_pylist() for i in range(3))
            for i, text in enumerate(texts):
                if parts[i] == 0:
                    end()
                    conv, state = convs[i], {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "tokens": 0}
                for role, said in parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                starts, ends, mask = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (4, 5, 6))
                for said in map(unescape, masked_text(text, starts, ends, mask)):
                    state["loss_chars"] += len(said)
                    state["loss"].update(said.encode())
                state["chars"] += len(text)
                state["tokens"] += len(starts)
            yield flush()
            rows.clear()
        end()
        yield flush()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
