"""Nearest vectors and keyword search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.semantics import quoted


#: Rows, and queries, whose scores a worker holds at once, and candidates that it gathers for such queries before it keeps the best of each.
ROWS, QUERIES, CANDIDATES = 256, 1024, 1 << 14
#: Best rows that one scan keeps in a worker; queries that together ask for more take further scans.
KEPT = 1 << 20
#: Bytes of query vectors that go to every executor at once; more queries take further scans.
QUERY_BYTES = 32 << 20


def _matrix(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors of this length without missing components, and which those are; zero vectors stay zero."""
    fits = [v is not None and len(v) == length and None not in v for v in vectors.to_pylist()] if vectors.null_count or vectors.flatten().null_count else (
        np.diff(vectors.offsets.to_numpy()) == length).tolist()
    fits = np.array(fits, bool)
    kept = vectors.filter(pa.array(fits)) if not fits.all() else vectors
    rows = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(kept), length)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0), fits


def _best(pool: list[pd.DataFrame], k: int) -> pd.DataFrame:
    rows = pd.concat(pool, ignore_index=True) if len(pool) != 1 else pool[0]
    return rows.sort_values(["query", "score", "key"], ascending=[True, False, True], kind="stable").groupby("query", sort=False).head(k)


def vector_matches(df: DataFrame, vector: str, key: str, queries: Sequence[tuple[object, Sequence[float]]], k: int = 5) -> DataFrame:
    """query, place, key, score: for each query the k rows most similar to it by cosine, ties by key.

    Exact: tasks multiply their rows, a block at a time, with the queries, a block at a time, and send their best
    k of each query only.  `queries` are (name, vector) pairs of one length; those beyond QUERY_BYTES or KEPT take
    further scans.  A worker holds one block of scores, and of each query the best and some candidates.
    Rows with a null key or vector, a vector of another length or with missing components match nothing (see
    `vector_lengths`); zero vectors score 0.
    """
    spark, key_type = df.sparkSession, df.schema[key].dataType.simpleString()
    schema = f"query int, key {key_type}, score double"
    if not queries:
        return spark.createDataFrame([], f"query string, place int, key {key_type}, score double")
    length = len(queries[0][1])
    if any(len(v) != length for _, v in queries):
        raise ValueError("the vectors of the queries differ in length")
    rows = df.filter(quoted(key).isNotNull() & quoted(vector).isNotNull()).select(quoted(key).alias("key"), quoted(vector).alias("v"))
    step = max(1, min(QUERY_BYTES // (8 * max(length, 1)), KEPT // max(k, 1)))
    out: DataFrame | None = None
    for lo in range(0, len(queries), step):
        unit = np.array([v for _, v in queries[lo : lo + step]], np.float64).reshape(-1, length)
        norms = np.linalg.norm(unit, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast(np.divide(unit, norms, out=np.zeros_like(unit), where=norms > 0))

        def search(batches: Iterator[pa.RecordBatch], shared=shared, lo=lo) -> Iterator[pa.RecordBatch]:
            own, starts = shared.value, range(0, len(shared.value), QUERIES)
            least = np.full(len(own), -np.inf)  # of the k best so far
            pools: dict[int, list[pd.DataFrame]] = {q: [] for q in starts}
            waiting, kept, key_type = dict.fromkeys(starts, 0), dict.fromkeys(starts, 0), None
            for batch in batches:
                key_type = batch.column(0).type
                for a in range(0, batch.num_rows, ROWS):
                    part = batch.slice(a, ROWS)
                    units, fits = _matrix(part.column(1), length)
                    keys, n = part.column(0).filter(pa.array(fits)).to_pandas(), len(units)
                    if not n:
                        continue
                    # Always as many rows: BLAS rounds those at a block's edge otherwise, and copies would not tie.
                    units = np.concatenate([units, np.zeros((ROWS - n, length))])
                    for q in starts:
                        scores, bound = (own[q : q + QUERIES] @ units.T)[:, :n], least[q : q + QUERIES]
                        hit = scores >= bound[:, None]
                        if 0 < k < n and np.count_nonzero(hit) > 2 * k * len(bound):  # what the k best of this block exclude
                            ranked = np.where(np.isnan(scores), -np.inf, scores)
                            ranked.partition(n - k, axis=1)
                            np.maximum(bound, ranked[:, n - k], out=bound)
                            hit = scores >= bound[:, None]
                        query, row = np.nonzero(hit)
                        if not len(row):
                            continue
                        pools[q].append(pd.DataFrame({"query": (query + (q + lo)).astype(np.int32), "key": keys.iloc[row].to_numpy(), "score": scores[query, row]}))
                        waiting[q] += len(row)
                        if waiting[q] > CANDIDATES + kept[q]:
                            best = _best(pools[q], k)
                            pools[q], waiting[q], kept[q] = [best], 0, len(best)
                            full = best.groupby("query")["score"].agg(["size", "min"])
                            full = full[full["size"] == k]
                            least[full.index.to_numpy() - lo] = full["min"].to_numpy()
            for pool in pools.values():
                if pool:
                    best = _best(pool, k)
                    yield pa.RecordBatch.from_arrays([pa.array(best["query"], pa.int32()), pa.array(best["key"], key_type), pa.array(best["score"])], ["query", "key", "score"])

        found = rows.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    best = out.withColumn("place", place).filter(F.col("place") <= k)
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(queries)], T.StructType([
        T.StructField("query", T.IntegerType()), T.StructField("name", T._infer_type(queries[0][0]))]))
    return best.join(F.broadcast(names), "query").select(F.col("name").alias("query"), "place", "key", F.round("score", 4).alias("score"))


def vector_lengths(df: DataFrame, vector: str, length: int) -> DataFrame:
    """state, n: how many rows can be searched (whole), and how many not, as null, of another length, or with missing components."""
    v = quoted(vector)
    state = F.when(v.isNull(), "null").when(F.size(v) != length, "other length").when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "missing components")
    return df.groupBy(state.otherwise("whole").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(a, a))


def vector_topk(df: DataFrame, vector: str, key: str, query: Sequence[float], k: int = 5) -> DataFrame:
    """key, score: the k rows most similar to one query by cosine, score rounded to 4 places.

    Exact: every row is scored on the JVM where it is read and each task keeps its best k; for a set of queries
    see `vector_matches`.  Vectors of another length match nothing; zero vectors score 0.
    """
    length = sum(x * x for x in query) ** 0.5
    unit = F.lit([float(x) / length if length else 0.0 for x in query])
    score = F.try_divide(dot(quoted(vector), unit), norm(quoted(vector)))
    scored = df.filter(F.size(quoted(vector)) == len(query)).select(quoted(key), F.coalesce(score, F.lit(0.0)).alias("score"))
    return scored.orderBy(F.desc("score"), quoted(key)).limit(k).withColumn("score", F.round("score", 4))


def keyword_search(
    df: DataFrame, query: str, columns: Sequence[str], order_by: Sequence[str], k: int = 5
) -> DataFrame:
    """The first k rows, in row order, where any word of the query is inside the joined columns."""
    text = F.lower(F.concat_ws(" ", *[quoted(c).cast("string") for c in columns]))
    hit = F.lit(False)
    for word in query.lower().split():
        hit = hit | text.contains(word)
    return df.filter(hit).orderBy(*order_by).limit(k)
