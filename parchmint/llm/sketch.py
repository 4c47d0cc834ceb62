"""Counts and flags in cells of a fixed number, gathered from all partitions.

Each partition gives the cells it has seen, sorted and packed, in blocks of cells; a block is added up in two steps, so
that no task gets the blocks of all partitions. What comes out is of fixed size and may be broadcast.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import tidied

#: Cells in a block, as a power of two.
BLOCK_BITS = 19
#: Partial blocks that are added up in one task at first.
SPREAD = 8


def cell(h: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each hash (uint64)."""
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells of one block and their counts."""
    gaps = np.diff(cells, prepend=0).astype("<u4")
    low = np.minimum(gaps, 255).astype(np.uint8)
    few = np.minimum(counts, 255).astype(np.uint8)
    body = np.uint32(len(cells)).tobytes() + low.tobytes() + few.tobytes() + gaps[low == 255].tobytes() + counts[few == 255].astype("<u4").tobytes()
    return zlib.compress(body, 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = zlib.decompress(packed)
    n = int(np.frombuffer(body, "<u4", 1)[0])
    gaps = np.frombuffer(body, np.uint8, n, 4).astype(np.uint32)
    counts = np.frombuffer(body, np.uint8, n, 4 + n).astype(np.uint32)
    rest = np.frombuffer(body[4 + 2 * n :], "<u4")
    far = gaps == 255
    gaps[far] = rest[: far.sum()]
    counts[counts == 255] = rest[far.sum() :]
    return np.cumsum(gaps.astype(np.int64)), counts


class Cells:
    """The cells that a partition sees, packed whenever another PACK entries have come."""

    PACK = 1_000_000

    def __init__(self, bits: int):
        self.bits, self.new, self.held, self.packed = bits, [], 0, []

    def add(self, cells: np.ndarray) -> None:
        self.new.append(cells.astype(np.uint32))
        self.held += len(cells)
        if self.held > self.PACK:
            self._pack()

    def _pack(self) -> None:
        if not self.held:
            return
        cells, counts = np.unique(np.concatenate(self.new), return_counts=True)
        edges = np.searchsorted(cells, np.arange(0, (1 << self.bits) + 1, 1 << BLOCK_BITS))
        self.packed += [(k, _pack(cells[a:b].astype(np.int64) - (k << BLOCK_BITS), counts[a:b])) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
        self.new, self.held = [], 0

    def blocks(self) -> list[tuple[int, bytes]]:
        """All packed blocks; a block may come several times."""
        self._pack()
        return self.packed


def gathered(blocks: DataFrame, bits: int, finish) -> dict[int, bytes]:
    """finish(counts of a block's cells) as bytes, for each block that has any. blocks: block int, cells binary."""

    def total(table):
        counts = np.zeros(1 << BLOCK_BITS, np.uint32)
        for z in table.column("cells"):
            at, n = _unpack(z.as_py())
            counts[at] += n
        return counts

    def one(key, cells):
        return pa.Table.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([cells], pa.binary())})

    def partly(key, table):
        counts = total(table)
        at = np.flatnonzero(counts)
        return one(key, _pack(at, counts[at]))

    def wholly(key, table):
        return one(key, zlib.compress(finish(total(table)), 1))

    rows = blocks.select("block", "cells", F.pmod(F.crc32("cells"), F.lit(SPREAD)).alias("part"))
    first = rows.groupBy("block", "part").applyInArrow(partly, "block int, cells binary")
    last = first.groupBy("block").applyInArrow(wholly, "block int, cells binary")
    return {r.block: zlib.decompress(r.cells) for r in last.toLocalIterator()}


def in_order(parts: dict[int, bytes], bits: int, size: int) -> bytes:
    """All blocks in order, blocks of zeros (of `size` bytes) where there is none."""
    return b"".join(parts.get(k, bytes(size)) for k in range(1 << (bits - BLOCK_BITS)))


#: Cells of a filter: 2 to this power bits are broadcast (16 MB).
FLAG_BITS = 27


def flags(hashes: DataFrame) -> bytes:
    """A bit per cell, set for those of the hashes (one column of longs)."""

    def run(parts):
        seen = Cells(FLAG_BITS)
        for part in parts:
            seen.add(cell(part.column(0).to_numpy(zero_copy_only=False).view(np.uint64), FLAG_BITS))
        found = seen.blocks()
        if found:
            yield pa.RecordBatch.from_pydict({"block": pa.array([k for k, _ in found], pa.int32()), "cells": pa.array([z for _, z in found], pa.binary())})

    blocks = hashes.mapInArrow(tidied(run), "block int, cells binary")
    return in_order(gathered(blocks, FLAG_BITS, lambda n: np.packbits(n > 0).tobytes()), FLAG_BITS, 1 << (BLOCK_BITS - 3))


def passes(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes a filter (flags as uint8) lets pass."""
    at = cell(h, FLAG_BITS)
    return np.flatnonzero(held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
