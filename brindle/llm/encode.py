"""Encoding of texts with a public byte-level BPE vocabulary, and decoding."""

from __future__ import annotations

import base64
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from brindle.functions.arrow import column, map_batches, strings

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"

# Fixed value: the vocabulary's published pre-tokenisation pattern.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A space between two visible characters always opens the following piece, so the text may be cut
# there first; runs of white space are left to PIECES' own rules.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPANS = rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
# Where only single spaces and one or two line ends stand between visible characters, each space belongs
# to the piece after it and each line end is a piece, so plain splitting gives the same spans.
OTHER_SPACE = "[\\t\\v\\f\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
MEMO_ENTRIES = 400_000


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def merge_symbols(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one piece: a heap of (rank, position) over a doubly linked list of symbols.

    Each entry remembers the two symbols it would join; an entry whose symbols have changed since it
    was pushed is stale and is skipped. Ties of rank go to the leftmost pair.
    """
    whole = ranks.get(data)
    if whole is not None:
        return [whole]
    n = len(data)
    symbols: list[bytes | None] = [data[i : i + 1] for i in range(n)]
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = data[i : i + 2]
        if (rank := ranks.get(pair)) is not None:
            heap.append((rank, i, pair))
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        left = symbols[i]
        if left is None:
            continue
        j = following[i]
        if j >= n or len(left) + len(symbols[j]) != len(joined) or left + symbols[j] != joined:
            continue
        symbols[i], symbols[j] = joined, None
        k = following[i] = following[j]
        if k < n:
            previous[k] = i
            pair = joined + symbols[k]
            if (rank := ranks.get(pair)) is not None:
                heapq.heappush(heap, (rank, i, pair))
        if (h := previous[i]) >= 0:
            pair = symbols[h] + joined
            if (rank := ranks.get(pair)) is not None:
                heapq.heappush(heap, (rank, h, pair))
    return [ranks[s] for s in symbols if s is not None]


class Memo(dict):
    """Span -> ids, filled on demand. Emptied when full, so its size doesn't follow the corpus.

    ``lead`` is what stood before the span in the text and was cut off with it.
    """

    def __init__(self, merge, pieces: dict[str, tuple[int, ...]], lead: str = ""):
        super().__init__()
        self.merge, self.pieces, self.lead = merge, pieces, lead
        self.find = regex.compile(PIECES).findall

    def __missing__(self, span: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.find(self.lead + span):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = tuple(self.merge(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    self.pieces[piece] = ids
            out += ids
        result = tuple(out)
        if len(span) <= 64:
            self[span] = result
        return result


class Encoder:
    """Encodes texts; keeps what it has worked out for the worker's next ones."""

    def __init__(self, raw: bytes):
        self.ranks = load_ranks(raw)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.joined = {a << 8 | b for token in self.ranks for a, b in zip(token, token[1:])}
        self.bare, self.spaced = Memo(self.merge, self.pieces), Memo(self.merge, self.pieces, " ")
        self.newline = self.ranks[b"\n"]
        self.spans = re.compile(SPANS).findall
        self.other_space = re.compile(OTHER_SPACE).search

    def merge(self, data: bytes) -> list[int]:
        """merge_symbols, first cut wherever two bytes meet that no vocabulary entry has side by side.

        No merge can reach over such a place, so the parts' ids are the piece's; parts repeat far more
        often than whole runs of a script without spaces.
        """
        if data.isascii():
            return merge_symbols(data, self.ranks)
        out: list[int] = []
        start, joined, before = 0, self.joined, data[0]
        for i in range(1, len(data) + 1):
            if i == len(data) or (before << 8 | data[i]) not in joined:
                part = data[start:i]
                ids = self.parts.get(part)
                if ids is None:
                    ids = merge_symbols(part, self.ranks)
                    if i - start <= 64:
                        self.parts[part] = ids
                out += ids
                start = i
            if i < len(data):
                before = data[i]
        return out

    def uneven(self, t: str) -> bool:
        return "  " in t or "\n " in t or " \n" in t or "\n\n\n" in t or t[0] in " \n" or t[-1] in " \n" or self.other_space(t) is not None

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.uneven(text):
            return list(chain.from_iterable(map(self.bare.__getitem__, self.spans(text))))
        out: list[int] = []
        for line in text.split("\n"):
            if line:
                first, *rest = line.split(" ")
                out += self.bare[first]
                if rest:
                    out += chain.from_iterable(map(self.spaced.__getitem__, rest))
            out.append(self.newline)
        out.pop()
        return out

    def trim(self) -> None:
        for memo in (self.bare, self.spaced, self.pieces, self.parts):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()


_loaded: dict[int, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """One per worker and vocabulary."""
    key = hash(raw)
    if key not in _loaded:
        _loaded[key] = Encoder(raw)
    return _loaded[key]


def decode(ids, raw: bytes) -> str:
    """Concatenate the vocabulary's byte strings."""
    at = {v: k for k, v in load_ranks(raw).items()}
    return b"".join(at[i] for i in ids).decode("utf-8", "replace")


def encode_texts(df: DataFrame, key: str, text: str = "text", vocabulary: str = BYTE_BPE_50K, ids: str = "ids") -> DataFrame:
    """(key, ids ARRAY<INT>), one row per input row, without special tokens.

    Null and empty texts give an empty list; text that spells a special token is ordinary text;
    repeated rows give repeated results; other columns are not read. Narrow: no shuffle of its own.
    The vocabulary file (0.8 MB, fixed) travels as a broadcast.
    """
    raw = df.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())
    kind = df.schema[key].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(raw.value)
        lists = list(map(own.encode, strings(batch, "_text")))
        own.trim()
        ends = np.zeros(len(lists) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in lists], out=ends[1:])
        flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1]))
        return pa.RecordBatch.from_arrays([column(batch, "_key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["_key", "ids"])

    out = map_batches(df.select(df[key].alias("_key"), df[text].alias("_text")), kernel, f"_key {kind}, ids array<int>")
    return out.select(out["_key"].alias(key), out["ids"].alias(ids))


def count_tokens(df: DataFrame, key: str, text: str = "text", vocabulary: str = BYTE_BPE_50K, *keep: str) -> DataFrame:
    """(key, *keep, n_tokens BIGINT): the encoder's lengths, without sending the ids to the JVM."""
    raw = df.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())
    names = [key, *keep]
    fields = ", ".join(f"_c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(raw.value)
        sizes = pa.array([len(own.encode(t)) for t in strings(batch, "_text")], pa.int64())
        own.trim()
        return pa.RecordBatch.from_arrays([*[column(batch, f"_c{i}") for i in range(len(names))], sizes], [*[f"_c{i}" for i in range(len(names))], "n_tokens"])

    out = map_batches(df.select(*[df[c].alias(f"_c{i}") for i, c in enumerate(names)], df[text].alias("_text")), kernel, f"{fields}, n_tokens bigint")
    return out.select(*[out[f"_c{i}"].alias(c) for i, c in enumerate(names)], "n_tokens")
