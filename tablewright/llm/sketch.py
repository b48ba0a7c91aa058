"""Count-min sketches of hashes, built per partition and merged, that tell which hashes may repeat.

A sketch has DEPTH rows of cells.  A hash adds one to a cell of each row; its estimate, the least of its
cells, is never too low.  Tasks send the cells that they touched with their counts, sorted and packed, block
by block, and a block's cells are added up in one task.  Of the sums there remain a bit for each cell (once,
or more often) and, for the cells of HOT or more, the power of two.

While the widest row has a cell a hash, all of it goes to every worker (`build_repeats`).  Beyond, it stays in
the tasks that add it up, and these answer those who sent cells (`with_levels`): a sketch of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import give_back, lean, stored
from tablewright.llm.wordhash import mix

DEPTH = 2
#: Cells of a block, as a power of two: what one task merges.
BLOCK_BITS = 21
#: Most cells of a row, as a power of two: 2 x 2**28 bits are 64 MB, which every worker gets.
MOST_BITS = 28
#: Hashes that a task gathers before it sends their cells.
FLUSH = 1 << 19
#: Hashes of a chunk, about, where the sketch is not sent whole; most cells of its blocks, as a power of two; cells wanted in a message.
CHUNK, WIDE_BLOCK_BITS, MESSAGE = 1 << 21, 24, 64

#: Counts from which a cell's power of two is kept, and for how many cells of a row at most (the largest).
HOT, MOST_HOT = 16, 1 << 20


class Repeats:
    """Bit rows of the merged sketch, and its hot cells.  With no rows every hash counts as repeated."""

    def __init__(self, bits: int, rows: list[np.ndarray], hot: list[tuple[np.ndarray, np.ndarray]]):
        self.bits, self.rows, self.hot = bits, rows, hot

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """0 for a hash that occurs once, 1 for a repeated one, the power of two of the estimate for a hot one."""
        out = self(hashes).astype(np.uint8)
        more = np.flatnonzero(out)
        levels = np.full(len(more), 255 if self.rows else 1, np.uint8)
        for seed, (cells, powers) in enumerate(self.hot):
            if not len(cells):
                levels[:] = 1
                break
            cell = mix(hashes[more], seed + 1) >> np.uint64(64 - self.bits)
            at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
            levels = np.minimum(levels, np.where(cells[at] == cell, powers[at], 1))
        out[more] = levels
        return out

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """True where a hash may occur more than once; never False where it does."""
        out = np.ones(len(hashes), bool)
        for seed, row in enumerate(self.rows):
            cell = mix(hashes, seed + 1) >> np.uint64(64 - self.bits)
            out &= (row[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values, prepend=np.uint32(0)).astype(np.uint32).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32), dtype=np.uint32)


def _touched(hashes: np.ndarray, bits: int, block_bits: int = BLOCK_BITS) -> Iterator[pd.DataFrame]:
    """Cells that the hashes touch, in order, with their counts: a row for each row of the sketch and block."""
    for seed in range(DEPTH):
        cells = mix(hashes, seed + 1)
        cells >>= np.uint64(64 - bits)
        cells.sort()
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        cells, counts = cells[first], np.diff(first, append=len(cells))
        blocks = (cells >> np.uint64(block_bits)).astype(np.int64)
        inside = (cells & np.uint64((1 << block_bits) - 1)).astype(np.uint32)
        edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
        rows = [(seed << 32 | int(blocks[a]), _pack(inside[a:b]), zstandard.ZstdCompressor(level=1).compress(counts[a:b].astype(np.uint32).tobytes())) for a, b in zip(edges[:-1], edges[1:])]
        yield pd.DataFrame(rows, columns=["block", "cells", "counts"])


def fits(expected: int) -> bool:
    """Whether a sketch of so many hashes, about, is small enough for every worker."""
    return expected <= 1 << MOST_BITS


def build_repeats(rows: DataFrame, hashes: Callable[[pd.DataFrame], np.ndarray], expected: int) -> Repeats:
    """The merged sketch of the hashes of `rows`.

    The width follows `expected`, the number of hashes about, for which `fits` holds.
    """
    bits = max(BLOCK_BITS, min(MOST_BITS, int(2 * max(expected, 1) - 1).bit_length()))

    def touch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, total = [], 0
        for batch in batches:
            waiting.append(hashes(batch))
            total += len(waiting[-1])
            if total >= FLUSH:
                yield from _touched(np.concatenate(waiting), bits)
                waiting, total = [], 0
                give_back()
        if total:
            yield from _touched(np.concatenate(waiting), bits)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, own = None, np.zeros(1 << BLOCK_BITS, np.uint32)

        def merged() -> pd.DataFrame:
            hot = np.flatnonzero(own >= HOT).astype(np.uint32)
            powers = np.log2(own[hot]).astype(np.uint8)
            return pd.DataFrame({"block": [current], "bits": [np.packbits(own > 1, bitorder="little").tobytes()], "hot": [hot.tobytes()], "powers": [powers.tobytes()]})

        for batch in batches:
            for block, cells, counts in zip(batch["block"], batch["cells"], batch["counts"]):
                if block != current:
                    if current is not None:
                        yield merged()
                    current = block
                    own[:] = 0
                own[_unpack(cells)] += np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.uint32)
        if current is not None:
            yield merged()

    touched = rows.mapInPandas(lean(touch), "block long, cells binary, counts binary")
    blocks = min(DEPTH << (bits - BLOCK_BITS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = touched.repartition(blocks, F.col("block")).sortWithinPartitions("block").mapInPandas(lean(merge), "block long, bits binary, hot binary, powers binary")
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(DEPTH)]
    hot: list[list] = [[] for _ in range(DEPTH)]
    size = 1 << (BLOCK_BITS - 3)
    for row in merged.toLocalIterator():
        seed, block = row.block >> 32, row.block & 0xFFFFFFFF
        out[seed][block * size :][:size] = np.frombuffer(row.bits, np.uint8)
        hot[seed].append((np.frombuffer(row.hot, np.uint32).astype(np.uint64) + np.uint64(block << BLOCK_BITS), np.frombuffer(row.powers, np.uint8)))
    return Repeats(bits, out, [_hottest(*map(np.concatenate, zip(*own))) if own else (np.zeros(0, np.uint64), np.zeros(0, np.uint8)) for own in hot])


def with_levels(rows: DataFrame, hashes: Callable[[pd.DataFrame], list[np.ndarray]], use: Callable[[pd.DataFrame, list[np.ndarray], list[np.ndarray]], pd.DataFrame], schema: str, expected: int) -> DataFrame:
    """`use`(rows, hashes of each, levels of each as in Repeats) over all rows, chunk by chunk, for any number of hashes.

    Rows are dealt to chunks of about CHUNK hashes; a longer row is in one chunk.  A chunk sends the cells it
    touches, packed, once each; the task that adds up a block answers with a byte for each cell, in the sender's
    order, also packed, and the answers meet the chunk again.  No task holds more than a chunk or a block, and a
    hash that is everywhere is one cell of each message.  Blocks widen with the sketch, so that messages stay long.
    """
    chunks = max(1, -(-expected // CHUNK))
    bits = max(BLOCK_BITS, int(2 * max(expected, 1) - 1).bit_length())
    block_bits = max(BLOCK_BITS, min(WIDE_BLOCK_BITS, bits - (CHUNK // MESSAGE).bit_length() + 1))
    dealt = stored(rows.withColumn("__chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks))))

    def touch(key: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([np.zeros(0, np.uint64), *hashes(chunk)])
        sent = pd.concat(_touched(own, bits, block_bits)) if len(own) else pd.DataFrame({"block": [], "cells": [], "counts": []})
        return sent.assign(chunk=key[0])

    def answer(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(1 << block_bits, np.uint32)
        for touched, counts in zip(sent["cells"], sent["counts"]):
            cells[_unpack(touched)] += np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.uint32)
        levels = (cells > 1).astype(np.uint8)
        hot = np.flatnonzero(cells >= HOT)
        levels[hot] = np.log2(cells[hot]).astype(np.uint8)
        packed = [zstandard.ZstdCompressor(level=1).compress(levels[_unpack(touched)].tobytes()) for touched in sent["cells"]]
        return pd.DataFrame({"chunk": sent["chunk"], "block": key[0], "levels": packed})

    def take(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = hashes(chunk)
        joined = np.concatenate([np.zeros(0, np.uint64), *own])
        levels = np.full(len(joined), 255, np.uint8)
        answers = answers.sort_values("block")
        rows_of = answers["block"].to_numpy(np.int64) >> 32
        for seed in range(DEPTH if len(joined) else 0):
            _, places = np.unique(mix(joined, seed + 1) >> np.uint64(64 - bits), return_inverse=True)
            got = b"".join(map(zstandard.ZstdDecompressor().decompress, answers["levels"][rows_of == seed]))
            levels = np.minimum(levels, np.frombuffer(got, np.uint8)[places])
        return use(chunk, own, np.split(levels, np.cumsum([len(h) for h in own])[:-1]))

    sent = dealt.groupBy("__chunk").applyInPandas(touch, "block long, cells binary, counts binary, chunk long")
    answers = sent.groupBy("block").applyInPandas(answer, "chunk long, block long, levels binary")
    return dealt.groupBy("__chunk").cogroup(answers.groupBy("chunk")).applyInPandas(take, schema)


def _hottest(cells: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most MOST_HOT cells, whole powers of two at a time, in order."""
    least = 0
    while np.count_nonzero(powers >= least) > MOST_HOT:
        least += 1
    keep = powers >= least
    order = np.argsort(cells[keep])
    return cells[keep][order], powers[keep][order]
