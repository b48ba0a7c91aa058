"""The range join of vectors against all pairs, over cells, blocks and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tablewright.llm.metric_join import exact_cosine, range_join

RNG = np.random.default_rng(12)


def rows():
    """Tight clusters around and beyond the bound, copies, multiples, a chain, odd vectors, three labels of one vector."""
    out = []
    for label in (0, 1):
        for _ in range(6):
            centre = RNG.normal(size=16)
            for _ in range(30):
                out.append((centre + RNG.normal(size=16) * RNG.choice([0.05, 0.12, 0.2]), label))
        out += [(RNG.normal(size=16), label) for _ in range(60)]
    out += [(out[3][0], 0)] * 5 + [(out[3][0] * 4, 0), (out[3][0], 1), (out[3][0], None)]
    angle = math.acos(0.981)
    out += [(np.array([math.cos(k * angle), math.sin(k * angle), *[0.0] * 14]), 2) for k in range(20)]
    out = [([float(x) for x in np.float32(v)], label) for v, label in out]
    out += [(None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] + [1.0] * 15, 0), ([float("inf")] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0)]
    out += [([1.0, 0.0], 0), ([1.0, -0.0], 0), ([1e-30, 0.0], 0), ([1e30, 1e29], 0)]
    table = [(int(i), v, label) for i, (v, label) in zip(RNG.permutation(len(out)), out)]
    return table + [table[0], (None, table[0][1], table[0][2]), (None, [3.0, 4.0], 2), (table[5][0], table[50][1], table[50][2])]


def brute(table, cosine=0.98):
    usable = [v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in table]
    arrays = [np.array(v, float) / max(map(abs, v)) if ok else None for (_, v, _), ok in zip(table, usable)]
    root, links = list(range(len(table))), [0] * len(table)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(table)):
        for j in range(i):
            if usable[i] and usable[j] and table[i][2] == table[j][2] and len(arrays[i]) == len(arrays[j]) and exact_cosine(arrays[i], arrays[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for k, (i, _, _) in enumerate(table):
        key = -(1 << 63) if i is None else i
        low[find(k)] = min(low.get(find(k), key), key)
    name = [low[find(k)] for k in range(len(table))]
    return sorted(((i, n, None if c == -(1 << 63) else c) for (i, _, _), n, c in zip(table, links, name)), key=str)


TABLE = rows()


@pytest.mark.parametrize("cell", [2_000, 40, 7])
def test_join_equals_all_pairs(spark, cell):
    frame = spark.createDataFrame(TABLE, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS v", "'x' AS node", "2 AS `group`", "3 AS links")
    got = sorted((tuple(r) for r in range_join(frame, cell=cell).collect()), key=str)
    assert got == brute(TABLE)


def test_double_vectors_and_text_labels(spark):
    table = [(i, v, None if label is None else f"l{label}") for i, v, label in TABLE]
    frame = spark.createDataFrame(table, "id long, e array<double>, name string")
    got = range_join(frame, id_column="id", vector="e", label="name", cell=50)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(table)


def test_empty_table(spark):
    assert range_join(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
