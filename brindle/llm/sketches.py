"""Mergeable summaries of a table whose size doesn't follow its rows: hashed counts and id filters.

Each task folds its rows into one array. Tasks' arrays are added slice by slice, FAN of them at a time, in
as many rounds as their number asks for, so that the adding spreads over more tasks as the input grows;
the driver receives one array.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.arrow import pieces

SLICES, FAN = 32, 64


def _merged(df: DataFrame, fold: Callable[[pa.RecordBatch, np.ndarray], None], size: int, dtype: str, top: int, bitwise: bool, finish: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    width = size // SLICES
    schema = "slice int, task int, part binary"

    def row(slices: list[int], task: int, parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([task] * len(slices), pa.int32()), pa.array(parts, pa.binary())], ["slice", "task", "part"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, dtype=np.uint8 if bitwise else np.uint32)
        for batch in batches:
            if batch.num_rows:
                fold(batch, own)
        if own.any():
            parts = (own[i * width : (i + 1) * width] for i in range(SLICES))
            yield row(list(range(SLICES)), TaskContext.get().partitionId(), [zlib.compress((x if bitwise else np.minimum(x, top).astype(dtype)).tobytes(), 1) for x in parts])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, t, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = np.frombuffer(zlib.decompress(part), dtype=dtype)
                if (k, t) not in sums:
                    sums[k, t] = x.astype(np.uint8 if bitwise else np.int64)
                elif bitwise:
                    sums[k, t] |= x
                else:
                    sums[k, t] += x
        for (k, t), x in sums.items():
            yield row([k], t, [zlib.compress((x if bitwise else np.minimum(x, top).astype(dtype)).tobytes(), 1)])

    parts, left = df.mapInArrow(partial, schema), df.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN)
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).repartition(min(8, SLICES) * left, "slice", "task").mapInArrow(total, schema)
    finish = finish or (lambda x: x)
    out = np.zeros(size, dtype=finish(np.zeros(1, dtype=dtype)).dtype)
    for k, _, part in parts.collect():
        out[k * width : (k + 1) * width] = finish(np.frombuffer(zlib.decompress(part), dtype=dtype))
    return out


def hashed_counts(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int, finish: Callable[[np.ndarray], np.ndarray] | None = None, rows: int | None = None) -> np.ndarray:
    """Counts of uint64 hashes by their lowest ``bits`` bits, saturating at 2^32 - 1: 4 * 2^bits bytes.

    ``hashes`` gets at most ``rows`` rows at a time. With ``finish``, which maps 0 to 0, the driver holds what it makes of them instead, a slice of the counts at a time.
    """
    mask = np.uint64((1 << bits) - 1)

    def fold(batch: pa.RecordBatch, own: np.ndarray) -> None:
        for piece in pieces(batch, rows):
            np.add.at(own, (hashes(piece) & mask).astype(np.int64), np.uint32(1))  # no second table beside the task's own

    return _merged(df, fold, 1 << bits, "uint32", 2**32 - 1, False, finish)


def rarity(counts: np.ndarray) -> np.ndarray:
    """A byte per bucket that grows with the logarithm of its count: an order of rarity to broadcast."""
    return np.minimum(np.log2(counts.astype(np.float64) + 1) * 8, 255).astype(np.uint8)


class IdFilter:
    """Bitmap of hashed ids, 16 bits an id: no false negatives, under 2 % false positives up to MOST ids.

    Beyond MOST ids (a bitmap of 16 MB) false positives grow; what may be held is then looked up more often.
    """

    MOST = 1 << 23

    def __init__(self, bitmap: np.ndarray):
        self.bitmap, self.bits = bitmap, len(bitmap).bit_length() + 2

    @staticmethod
    def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        y = x * np.uint64(0xC2B2AE3D27D4EB4F)
        return x >> np.uint64(64 - bits), y >> np.uint64(64 - bits)

    @staticmethod
    def of(df: DataFrame, count: int) -> "IdFilter":
        """Of all BIGINT columns of ``df``, which hold ``count`` ids (about)."""
        bits = min(max(14, int(count).bit_length() + 4), IdFilter.MOST.bit_length() + 3)

        def fold(batch: pa.RecordBatch, own: np.ndarray) -> None:
            for c in batch.columns:
                for b in IdFilter._places(c.to_numpy(zero_copy_only=False).astype(np.int64), bits):
                    np.bitwise_or.at(own, (b >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (b & np.uint64(7)).astype(np.uint8)))

        return IdFilter(_merged(df, fold, 1 << (bits - 3), "uint8", 255, True))

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), dtype=bool)
        for b in IdFilter._places(ids.astype(np.int64), self.bits):
            out &= (self.bitmap[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out
