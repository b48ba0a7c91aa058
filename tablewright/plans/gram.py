"""Co-moments of all pairs of columns from one scan.

Each Arrow batch becomes matrices: how many rows have both columns, their means over those rows, squares and
products of the deviations.  States merge by the rule for co-moments, batch by batch in a task, then in two
levels of tasks, so nothing loses digits to a far-off centre and the driver gets a row a column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.semantics import quoted

#: Tasks whose states the first level of merging brings together, as this many groups a column.
GROUPS = 32


@dataclass
class CoMoments:
    """Over the rows where a column of the left side and one of the right are both present, for all such pairs.

    n: rows; mean_a, mean_b: means; sq_a, sq_b: sums of squared deviations; prod: of products of deviations.
    """

    n: np.ndarray
    mean_a: np.ndarray
    mean_b: np.ndarray
    sq_a: np.ndarray
    sq_b: np.ndarray
    prod: np.ndarray

    FIELDS = ("n", "mean_a", "mean_b", "sq_a", "sq_b", "prod")

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> CoMoments:
        """Of two blocks of rows; NaN is missing."""
        there_a, there_b = ~np.isnan(a), ~np.isnan(b)
        with np.errstate(all="ignore"):
            centre = lambda x, there: np.where(there.any(0), np.where(there, x, 0).sum(0) / np.maximum(there.sum(0), 1), 0)
            ca, cb = centre(a, there_a), centre(b, there_b)
            xa, xb = np.where(there_a, a - ca, 0), np.where(there_b, b - cb, 0)
            there_a, there_b = there_a.astype(float), there_b.astype(float)
            n = there_a.T @ there_b
            some = np.maximum(n, 1)
            sum_a, sum_b = xa.T @ there_b, there_a.T @ xb
            return cls(
                n, ca[:, None] + sum_a / some, cb[None] + sum_b / some,
                (xa * xa).T @ there_b - sum_a * sum_a / some, there_a.T @ (xb * xb) - sum_b * sum_b / some, xa.T @ xb - sum_a * sum_b / some)

    def merge(self, other: CoMoments) -> CoMoments:
        with np.errstate(all="ignore"):
            n = self.n + other.n
            some = np.maximum(n, 1)
            both = self.n * other.n / some
            mean = lambda x, y: np.where(self.n == 0, y, np.where(other.n == 0, x, x + (y - x) * (other.n / some)))
            move = lambda x, y: np.where(both > 0, y - x, 0)
            da, db = move(self.mean_a, other.mean_a), move(self.mean_b, other.mean_b)
            return CoMoments(
                n, mean(self.mean_a, other.mean_a), mean(self.mean_b, other.mean_b), self.sq_a + other.sq_a + da * da * both,
                self.sq_b + other.sq_b + db * db * both, self.prod + other.prod + da * db * both)

    def pack(self, row: int) -> bytes:
        return np.stack([getattr(self, f)[row] for f in self.FIELDS]).tobytes()

    @classmethod
    def unpack(cls, rows: Sequence[bytes], width: int) -> CoMoments:
        return cls(*np.stack([np.frombuffer(r).reshape(len(cls.FIELDS), width) for r in rows], 1))


_STATE = "i int, g int, state binary, size double"


def _merged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """States of equal (i, g) merged, in the order in which they come."""
    states: dict[tuple[int, int], tuple[CoMoments, float]] = {}
    for batch in batches:
        for i, g, state, size in zip(*(c.to_pylist() for c in batch.columns)):
            own = CoMoments.unpack([state], width)
            if (i, g) in states:
                old, most = states[i, g]
                own, size = old.merge(own), max(most, size)
            states[i, g] = own, size
    if states:
        rows = [(i, g, own.pack(0), size) for (i, g), (own, size) in states.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.float64()))], ["i", "g", "state", "size"])


def co_moments(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> tuple[CoMoments | None, np.ndarray]:
    """Co-moments of each column of `left` with each of `right`, and the largest absolute value of each of `left`.

    One scan, whatever the number of columns; None for a table without rows.  Nulls and NaN are missing.
    """
    left, right = list(left), list(right)
    names = list(dict.fromkeys([*left, *right]))
    at_a, at_b = [names.index(c) for c in left], [names.index(c) for c in right]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size, part = None, np.zeros(len(left)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float)
            a = x[:, at_a]
            own = CoMoments.of(a, x[:, at_b])
            state = own if state is None else state.merge(own)
            size = np.maximum(size, np.abs(np.where(np.isnan(a), 0, a)).max(0))
        if state is not None:
            rows = range(len(left))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array([part % GROUPS] * len(left), pa.int32()), pa.array([state.pack(i) for i in rows], pa.binary()), pa.array(size)],
                ["i", "g", "state", "size"])

    width = len(right)
    rows = df.select(F.spark_partition_id().alias("__part"), *[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    states = rows.mapInArrow(fold, _STATE)
    once = states.repartition("i", "g").sortWithinPartitions("i", "g").mapInArrow(lambda b: _merged(b, width), _STATE)
    twice = once.select("i", F.lit(0).alias("g"), "state", "size").repartition("i").mapInArrow(lambda b: _merged(b, width), _STATE)
    found = sorted(twice.collect(), key=lambda r: r["i"])
    if not found:
        return None, np.zeros(len(left))
    return CoMoments.unpack([bytes(r["state"]) for r in found], width), np.array([r["size"] for r in found])
