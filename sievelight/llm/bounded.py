"""Bounded tables built over a whole collection: counting sketches and bitmaps of fixed size.

Every task adds its rows to a sparse part, parts are merged by chunk on the executors, and what reaches the driver
(and from there the executors, as a broadcast) has the size given by ``bits`` whatever the number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

CHUNK_BITS = 20
#: Counts are kept as one of sixteen levels; level i stands for a count from LEVELS[i] up to below LEVELS[i + 1].
LEVELS = np.array([0, 1, 2, 3, 4, 6, 8, 16, 32, 64, 256, 1024, 8192, 65536, 524288, 4194304])


def _packed(cells: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sorted cells and their counts as one compressed part for each chunk."""
    z = zstandard.ZstdCompressor(level=3)
    chunk = cells >> CHUNK_BITS
    cut = np.flatnonzero(np.diff(chunk)) + 1
    for c, n in zip(np.split(cells, cut), np.split(counts, cut)):
        if len(c):
            first = int(c[0] >> CHUNK_BITS)
            step = np.diff(c - (first << CHUNK_BITS), prepend=0).astype(np.uint32)
            yield first, z.compress(step.tobytes() + np.minimum(n, (1 << 32) - 1).astype(np.uint32).tobytes())


def bits_for(n: int, least: int, most: int) -> int:
    """Bits of a table with a cell or more for each of n items, within bounds."""
    return min(most, max(least, int(n).bit_length()))


class Parts:
    """Collects the cells of a task and gives them out as (chunk, part) rows when they are many or at the end."""

    def __init__(self, most: int = 1 << 22):
        self.most, self.held, self.size = most, [], 0

    def add(self, cells: np.ndarray) -> list[tuple[int, bytes]]:
        self.held.append(np.sort(cells.astype(np.int32 if not len(cells) or cells.max() < 1 << 31 else np.int64)))
        self.size += len(cells)
        return self.flush() if self.size > self.most else []

    def flush(self) -> list[tuple[int, bytes]]:
        if not self.size:
            return []
        cells = np.sort(np.concatenate(self.held)).astype(np.int64)
        self.held, self.size = [], 0
        start = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        return list(_packed(cells[start], np.diff(np.concatenate((start, [len(cells)])))))


def merged_sketch(parts: DataFrame, bits: int) -> Broadcast:
    """Broadcast of 2**bits four-bit levels (packed, two a byte) of (chunk, part) rows: how often each cell occurs.

    A level never stands for fewer than the true occurrences; colliding items only raise it. Parts of a chunk are
    added up on the executors; 2 ** (bits - 1) bytes reach the driver."""

    def merged(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << min(bits, CHUNK_BITS), np.int64)
        d = zstandard.ZstdDecompressor()
        for p in t.column("part").to_pylist():
            raw = d.decompress(p)
            n = len(raw) // 8
            cells = np.cumsum(np.frombuffer(raw[: 4 * n], np.uint32).astype(np.int64))
            total[cells] += np.frombuffer(raw[4 * n :], np.uint32)
        level = (np.searchsorted(LEVELS, total, side="right") - 1).astype(np.uint8)
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "levels": pa.array([(level[::2] | (level[1::2] << 4)).tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 1), np.uint8)
    width = (1 << min(bits, CHUNK_BITS)) // 2
    for r in parts.groupBy("chunk").applyInArrow(merged, "chunk long, levels binary").toLocalIterator():  # at most 2 ** (bits - CHUNK_BITS) rows
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.levels, np.uint8)
    return parts.sparkSession.sparkContext.broadcast(out)


def levels(packed: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The level of each cell."""
    return (packed[cells >> 1] >> ((cells & 1) << 2).astype(np.uint8)) & 15


def member_bitmap(df: DataFrame, column: str, bits: int) -> Broadcast:
    """Broadcast bitmap of 2**bits bits with the bit of every value of a long column set (a one-hash Bloom filter):
    a value that occurs is always in it. 2 ** bits / 8 bytes a task reach the driver, from sixteen tasks at most."""

    def fill(batches):
        bitmap = np.zeros(1 << bits, bool)
        for b in batches:
            bitmap[b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)] = True
        yield pa.RecordBatch.from_pydict({"bitmap": pa.array([zstandard.compress(np.packbits(bitmap).tobytes(), 1)], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in df.select(column).coalesce(16).mapInArrow(fill, "bitmap binary").collect():
        out |= np.frombuffer(zstandard.decompress(r.bitmap), np.uint8)
    return df.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = (len(bitmap) * 8).bit_length() - 1
    at = values.astype(np.uint64, copy=False) >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
