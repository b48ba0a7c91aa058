"""One-scan co-moments and sets of query vectors against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from tablewright.operators import aggregate as A
from tablewright.operators import search as X
from tablewright.plans.gram import CoMoments

RNG = np.random.default_rng(8)


def table(n=3000, d=12):
    x = RNG.normal(size=(n, d)) @ RNG.normal(size=(d, d)) + RNG.normal(size=d) * 1e6
    x[:, 3] = x[:, 2] * 2 + 1
    x[:, 4] = 7.5
    x[RNG.random(x.shape) < 0.2] = np.nan
    x[:, 5] = np.sort(x[:, 5])
    x[:, 6] = np.nan
    return x


def want(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    return None if len(a) < 2 or a.std() == 0 or b.std() == 0 else float(np.corrcoef(a, b)[0, 1])


def test_all_pairs_with_gaps(spark):
    x = table()
    rows = [tuple(None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)) for r in x]
    names = [f"c {i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(9)
    got = {(r.column_a, r.column_b): r.r for r in A.correlation_pairs(df, names).collect()}
    assert len(got) == len(names) * (len(names) - 1) // 2
    for (a, b), r in got.items():
        w = want(x, names.index(a), names.index(b))
        assert (r is None) == (w is None) and (w is None or abs(r - w) < 1e-9), (a, b)
    matrix = {r[0]: r[1:] for r in A.correlation_matrix(df, names).collect()}
    assert matrix["c 4"][4] is None and matrix["c 0"][0] == 1.0 and matrix["c 2"][3] == got["c 2", "c 3"]
    importance = {r.column_name: r.importance for r in A.feature_importance(df, "c 0", names).collect()}
    assert importance["c 1"] == round(abs(want(x, 1, 0)), 4) and "c 0" not in importance


def test_correlations_of_many_columns_take_one_scan(spark):
    df = spark.range(50).selectExpr(*[f"cast((id * {i + 3}) % 17 AS double) AS c{i}" for i in range(40)])
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert A.correlation_pairs(df, df.columns).count() == 780
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 6  # one scan; adaptive execution runs each shuffle as a job


def test_merging_in_any_order_is_the_whole():
    x = table(500)
    whole = CoMoments.of(x, x[:, :5])
    parts = [CoMoments.of(p, p[:, :5]) for p in np.array_split(x, [1, 2, 40, 41, 300])]
    one = parts[0]
    for p in parts[1:]:
        one = one.merge(p)
    for f in CoMoments.FIELDS:
        assert np.allclose(getattr(whole, f)[whole.n > 0], getattr(one, f)[whole.n > 0], rtol=1e-9, atol=1e-4), f


def test_empty_and_tiny_tables(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert [tuple(r) for r in A.correlation_pairs(none, ["a", "b"]).collect()] == [("a", "b", None)]
    assert A.correlation_pairs(none, ["a"]).collect() == [] and A.feature_importance(none, "x", ["a"]).collect() == []


@pytest.mark.parametrize("limit", [X.QUERY_BYTES, 8 * 6 * 4])
def test_sets_of_queries(spark, monkeypatch, limit):
    monkeypatch.setattr(X, "QUERY_BYTES", limit)
    monkeypatch.setattr(X, "CANDIDATES", 50)
    vectors = RNG.normal(size=(400, 6)).round(1)
    vectors[7] = 0
    vectors[100:110] = vectors[3]
    rows = [(f"k{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(None, rows[0][1]), ("n", None), ("short", [1.0]), ("gap", [None, 1.0, 1.0, 1.0, 1.0, 1.0]), ("long", [1.0] * 7)]
    df = spark.createDataFrame(rows + odd, "name string, e array<double>").repartition(6)
    queries = [(i, rows[i][1]) for i in (0, 3, 7, 50, 99, 200, 399)]
    got = {}
    for r in X.vector_matches(df, "e", "name", queries, 4).collect():
        got.setdefault(r.query, []).append((r.place, r.key, r.score))
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for i, _ in queries:
        scores = unit @ unit[i]
        order = sorted(range(400), key=lambda k: (-round(scores[k], 12), k))[:4]
        assert [p for p, _, _ in sorted(got[i])] == [1, 2, 3, 4]
        assert np.allclose([s for _, _, s in sorted(got[i])], scores[order], atol=1e-4)
        if i != 7:
            assert {k for _, k, _ in got[i]} == {f"k{k:03d}" for k in order}
    states = {r.state: r.n for r in X.vector_lengths(df, "e", 6).collect()}
    assert states == {"whole": 401, "null": 1, "other length": 2, "missing components": 1}
    assert X.vector_matches(df, "e", "name", [], 4).collect() == []


def searched(monkeypatch, df, queries, batches, k=5):
    """What a task of the search makes of these batches, run here, and the most bytes that it held."""
    import tracemalloc

    tasks = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: tasks.append(run) or df.sparkSession.createDataFrame([], schema))
    X.vector_matches(df, "e", "k", queries, k)
    tracemalloc.start()
    found = [r for run in tasks for b in run(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, most


def batches_of(vectors, size):
    import pyarrow as pa

    at = range(0, len(vectors), size)
    return [pa.RecordBatch.from_arrays([pa.array(range(a, min(a + size, len(vectors)))), pa.array(list(vectors[a : a + size]))], ["key", "v"]) for a in at]


def test_a_search_holds_a_block_of_scores(spark, monkeypatch):
    vectors = RNG.normal(size=(3000, 8))
    vectors[500:900] = vectors[0]  # copies tie
    df = spark.createDataFrame([], "k long, e array<double>")
    queries = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found, most = searched(monkeypatch, df, queries, batches_of(vectors, 1000))
    assert len(found) == 5 * len(queries) and most < 40e6
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = {}
    for q, key, _ in found:
        got.setdefault(q, []).append(key)
    for q in (1, 499, 1023, 1024, 2999):
        assert got[q] == sorted(range(3000), key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))[:5]
    assert got[0] == got[700] == [0, 500, 501, 502, 503]


def test_copies_tie_wherever_they_lie(spark, monkeypatch):
    vectors = RNG.normal(size=(1100, 64))
    vectors[::2] = vectors[0]
    df = spark.createDataFrame([], "k long, e array<double>")
    found, _ = searched(monkeypatch, df, [(i, v.tolist()) for i, v in enumerate(vectors[1:18:2])], batches_of(vectors, 55), k=600)
    for q in range(9):
        copies = [(key, score) for x, key, score in found if x == q and key % 2 == 0]
        assert [key for key, _ in copies] == list(range(0, 1100, 2))[: len(copies)] and len({score for _, score in copies}) <= 1


def test_a_row_or_query_that_is_no_number_matches_nothing(spark, monkeypatch):
    vectors = RNG.normal(size=(900, 8))
    vectors[10:500, 3] = np.inf
    df = spark.createDataFrame([], "k long, e array<double>")
    found, _ = searched(monkeypatch, df, [(i, vectors[i].tolist()) for i in (0, 10, 899)], batches_of(vectors, 400))
    assert [(q, q != 1) for q, _, _ in found] == [(0, True)] * 5 + [(2, True)] * 5
    assert {key for _, key, _ in found} <= {*range(10), *range(500, 900)}
