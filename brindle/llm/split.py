"""Splitting of oversized texts at natural boundaries by dynamic programming."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.arrow import column, map_batches, strings

LIMIT, OVERLAP = 2000, 200
# Cut penalties, in units of the squared relative size error.
PARAGRAPH, SENTENCE, CLAUSE, WORD, INSIDE_MARK, FORCED = 0.0, 0.08, 0.35, 0.8, 1.5, 60.0
# The marks at which a text may be cut though no white space follows.
TERMINATORS = ".!?。！？।؟"
CLAUSE_MARKS = ",;:、，；：،؛"
CLOSERS = "\"'”’»)]」』）】"

_SPACE, _TERM, _CLAUSE, _CLOSE = 1, 2, 3, 4
_classes = np.zeros(0x110000, dtype=np.uint8)
for _i in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
    _classes[_i] = _SPACE
for _marks, _k in ((TERMINATORS, _TERM), (CLAUSE_MARKS, _CLAUSE), (CLOSERS, _CLOSE)):
    for _c in _marks:
        _classes[ord(_c)] = _k


def cut_penalties(text: str) -> np.ndarray:
    """Penalty of a cut before each position 0..n; FORCED where neither neighbour is white space or a terminator."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _classes[codes]
    n = len(codes)
    pen = np.full(n + 1, FORCED)
    before, after = kind[:-1], kind[1:]
    inner = pen[1:n]
    breakable = (before == _SPACE) | (before == _TERM) | (after == _SPACE) | (after == _TERM)
    inner[breakable] = INSIDE_MARK
    # a cut belongs after white space; what it is worth hangs on what stands before that white space
    space_end = (before == _SPACE) & (after != _SPACE)
    inner[space_end] = WORD
    ends = np.flatnonzero(space_end) + 1
    if len(ends):
        solid = np.where(kind == _SPACE, -1, np.arange(n))
        last = np.maximum.accumulate(solid)[ends - 1]  # last visible character before the white space
        mark = np.where(last >= 0, kind[last], 0)
        unclosed = mark == _CLOSE
        prev = np.where(unclosed & (last > 0), kind[np.maximum(last - 1, 0)], mark)
        pen[ends[prev == _TERM]] = SENTENCE
        pen[ends[(prev == _CLAUSE) | (unclosed & (prev != _TERM))]] = CLAUSE
        lines = np.concatenate([[0], np.cumsum(codes == 10)])
        feeds = lines[ends] - lines[last + 1]
        pen[ends[(feeds == 1) & (pen[ends] > CLAUSE)]] = CLAUSE
        pen[ends[feeds >= 2]] = PARAGRAPH
    # scripts without spaces: after a terminator, or a closer behind one
    tight = (before == _TERM) & (after != _SPACE) & (after != _TERM) & (after != _CLOSE)
    tight |= np.concatenate([[False], (kind[:-2] == _TERM) & (before[1:] == _CLOSE) & (after[1:] != _SPACE) & (after[1:] != _CLOSE)]) if n > 2 else False
    wide = np.concatenate([codes[:-1] > 0x2E80])
    inner[tight & wide] = SENTENCE
    pen[0] = pen[n] = 0.0
    return pen


def _begins(pen: np.ndarray, at: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece after a cut at each place starts: the best boundary about ``overlap`` back, or exactly that far back."""
    low, high = overlap // 2, overlap + overlap // 2
    out = np.maximum(at - overlap, 0)
    if high <= low:
        return out
    padded = np.concatenate([np.full(high, FORCED * 2), pen])  # padded[i + high] is pen[i]
    tent = np.abs(high - np.arange(high - low) - overlap) / (overlap * 4)
    for k in range(0, len(at), 4096):
        own = at[k : k + 4096]
        window = padded[own[:, None] + np.arange(high - low)]  # the positions from high to low + 1 back
        best = (window + tent).argmin(axis=1)
        place = own - high + best
        good = (window[np.arange(len(own)), best] < FORCED) & (place > 0)
        out[k : k + 4096][good] = place[good]
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], list[int], bool]:
    """(starts, ends, forced) of the pieces, in characters; a text within the limit is one piece.

    Minimises, over all sequences of boundary positions of the text, the sum of cut penalties, of squared
    deviations from the even piece size, and of overlap lost where a piece would burst the limit. A piece
    begins at the best boundary near ``overlap`` characters before the last cut, else exactly that far
    before it, and later only where the limit asks for it. Only where the text has more than ``limit``
    characters without a boundary is a cut forced, between characters.
    """
    n = len(text)
    if n <= limit:
        return [0], [n], False
    pen = cut_penalties(text)
    edges = np.concatenate([[0], np.flatnonzero(pen[1:n] < FORCED) + 1, [n]])
    gaps = np.diff(edges)
    if (gaps > limit).any():  # evenly spaced places inside the runs that nothing else can part
        step = max(1, limit - overlap)
        more = [np.arange(a + step, b, step) for a, b, g in zip(edges[:-1], edges[1:], gaps) if g > limit]
        edges = np.unique(np.concatenate([edges, *more]))
    begin = _begins(pen, edges, overlap)
    begin[0] = 0
    cuts = _cheapest(edges, begin, pen[edges], limit, overlap, n)
    starts, ends = [0], edges[cuts[1:]].tolist()
    for i, end in zip(cuts[1:-1], ends[1:]):
        starts.append(min(int(edges[i]), max(int(begin[i]), end - limit, starts[-1] + 1)))
    return starts, ends, bool((pen[edges[cuts[1:-1]]] >= FORCED).any())


def _cheapest(p: np.ndarray, begin: np.ndarray, pen: np.ndarray, limit: int, overlap: int, n: int) -> list[int]:
    """Indices into ``p`` of the cheapest cuts, the two ends included.

    All places within STEP characters are worked out in one matrix from the places before them. Should a
    piece from one of them to another pay as well, which its deviation hardly allows, they are gone
    through one by one.
    """
    m = len(p)
    count = max(2, -(-(n - overlap) // max(1, limit - overlap)))
    ideal = min(limit, (n + (count - 1) * overlap) / count)
    best, back = np.full(m, np.inf), np.zeros(m, np.int64)
    best[0] = 0.0
    step = max(1, limit // 5)
    where = begin * (2 / ideal) + 2  # in the unit in which a deviation's square is its cost
    shift = int((p - begin).max())

    def cost(low: int, high: int, ends: np.ndarray) -> np.ndarray:
        """Of pieces from the places low to high (columns) to the ends (rows)."""
        c = (ends * (2 / ideal))[:, None] - where[low:high]
        # further back than this a piece may burst the limit with its overlap, or without it
        far = min(high, int(np.searchsorted(p, ends[-1] - limit + shift)))
        if far > low:
            size = ends[:, None] - begin[low:far]
            np.minimum(c[:, : far - low], (limit - ideal) * (2 / ideal), out=c[:, : far - low])
        c *= c
        c += best[low:high]
        if far > low:
            c[:, : far - low] += np.maximum(size - limit, 0) * (3.0 / max(1, overlap))
            c[:, : far - low][ends[:, None] - p[low:far] > limit] = np.inf
        return c

    j = 1
    while j < m:
        stop = int(np.searchsorted(p, p[j - 1] + step, side="right"))
        stop = min(m, max(stop, j + 1))
        low = int(np.searchsorted(p, p[j] - limit))
        c = cost(low, j, p[j:stop])
        k = c.argmin(axis=1)
        best[j:stop] = c[np.arange(stop - j), k] + pen[j:stop]
        back[j:stop] = low + k
        own = best[j:stop]
        longest = max(0.0, 1 - (p[stop - 1] - begin[j:stop].min()) / ideal)
        for x in j + np.flatnonzero(own - pen[j:stop] > own.min() + 4 * longest * longest):
            if x > j:
                low = max(j, int(np.searchsorted(p, p[x] - limit)))
                c = cost(low, int(x), p[x : x + 1])[0]
                i = int(c.argmin())
                if c[i] + pen[x] < best[x]:
                    best[x], back[x] = c[i] + pen[x], low + i
        j = stop
    cuts = [m - 1]
    while cuts[-1]:
        cuts.append(int(back[cuts[-1]]))
    return cuts[::-1]


def split_items(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, starts, ends, forced) of every row whose text has more than ``limit`` characters.

    Null, empty and short texts have no row here (``pieces`` gives short ones back whole); equal texts
    and repeated rows are each split; extra columns are not read. The length test runs in the JVM, so
    only oversized texts reach Python; narrow, without a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [split_text(t, limit, overlap) for t in strings(batch, "_text")]
        arrays = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.bool_())]
        return pa.RecordBatch.from_arrays([column(batch, "_key"), *arrays], ["_key", "starts", "ends", "forced"])

    long = df.select(df[key].alias("_key"), df[text].alias("_text")).where(F.length("_text") > limit)
    out = map_batches(long, kernel, f"_key {kind}, starts array<int>, ends array<int>, forced boolean")
    return out.select(out["_key"].alias(key), "starts", "ends", "forced")


def split_pieces(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index from 0, total_chunks, start, text): the pieces of every oversized text, cut in Python once."""
    kind = df.schema[key].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, index, total, start, out = [], [], [], [], []
        for row, t in enumerate(strings(batch, "_text")):
            starts, ends, _ = split_text(t, limit, overlap)
            for k, (a, b) in enumerate(zip(starts, ends)):
                keys.append(row), index.append(k), total.append(len(starts)), start.append(a), out.append(t[a:b])
        taken = column(batch, "_key").take(pa.array(keys, pa.int64()))
        return pa.RecordBatch.from_arrays([taken, pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(start, pa.int32()), pa.array(out, pa.string())], ["_key", "chunk_index", "total_chunks", "start", "text"])

    long = df.select(df[key].alias("_key"), df[text].alias("_text")).where(F.length("_text") > limit)
    out = map_batches(long, kernel, f"_key {kind}, chunk_index int, total_chunks int, start int, text string")
    return out.select(out["_key"].alias(key), "chunk_index", "total_chunks", "start", "text")
