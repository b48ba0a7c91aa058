"""Exact range join of unit vectors: pivots cut the vectors into cells that join independently.

Cosine c and distance d of unit vectors are tied by d * d = 2 - 2c, so "cosine at least c" is "distance at
most r", and distance is a metric.  Every vector belongs to the cell of its nearest pivot.  What a vector x of
cell p links with lies within r of x, so by the triangle inequality within r of the cell's radius, and less
than 2r farther from p than from its own pivot; in between the bisector of two pivots, which is nearer, tells
it exactly.  Vectors that pass are replicated into the cell as guests, and each cell compares its own vectors
with all of its.  Equal vectors are compared once.  Large cells are cut into blocks, of which each pair is a
task of its own.  A task returns sums and a forest of its links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import stored, table
from tablewright.llm.components import components

COSINE = 0.98
#: Different vectors that a cell should have, and that a block of a larger cell has.
CELL = 2_000
#: Bytes of pivots that every executor gets at most; beyond, cells are larger and blocks do the rest.
PIVOT_BYTES = 16 << 20
#: Rows of a block that are multiplied at once.
ROWS = 256
#: Distances to pivots that a worker holds at once.
DISTANCES = 1 << 21
#: Cosines so near to the bound are computed again, with exact sums.
NEAR = 1e-12
#: What distances may be off by through rounding.
SLACK = 1e-7


def _packed(vectors: pa.Array) -> list[bytes | None]:
    """Vectors as bytes; None for null, empty and zero ones and those with null or non-finite components."""
    kind = np.float32 if pa.types.is_float32(vectors.type.value_type) else np.float64
    values = vectors.flatten()
    whole = np.ones(len(values), bool) if not values.null_count else values.is_valid().to_numpy(zero_copy_only=False)
    numbers = (values.fill_null(0) if values.null_count else values).to_numpy(zero_copy_only=False).astype(kind, copy=False) + kind(0)  # no -0.0
    lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(vectors).to_pylist()], np.int64)
    ends = np.cumsum(lengths)
    wrong = np.concatenate(([0], np.cumsum(~(whole & np.isfinite(numbers)))))
    some = np.concatenate(([0], np.cumsum(numbers != 0)))
    return [numbers[a:b].tobytes() if some[b] > some[a] and wrong[b] == wrong[a] else None for a, b in zip(ends - lengths, ends)]


def unit_rows(packed, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and scaled to length one."""
    raw = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    scaled = raw / np.abs(raw).max(1, keepdims=True)  # else squares of very large or small numbers are lost
    return scaled, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return fsum(x * y) / sqrt(fsum(x * x) * fsum(y * y))


def linked_block(own: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], cosine: float) -> np.ndarray:
    """Which of `others` each of `own` is linked with."""
    products = own[1] @ others[1].T
    links = products >= cosine
    for i, j in np.argwhere(np.abs(products - cosine) < NEAR):
        links[i, j] = exact_cosine(own[0][i], others[0][j]) >= cosine
    return links


def _vectors(rows: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """(id, key, label, v): a row each, v null where the vector cannot link.  A null id comes before all others."""
    kind = rows.schema[vector].dataType

    @F.arrow_udf("binary")
    def packed(vectors: pa.Array) -> pa.Array:
        return pa.array(_packed(vectors), pa.binary())

    usable = F.col(label).isNotNull() & F.col(vector).isNotNull()
    numbers = F.col(vector) if kind.elementType.typeName() in ("float", "double") else F.col(vector).cast("array<double>")
    found = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"), usable.alias("usable"), numbers.alias("numbers"))
    found = found.withColumn("v", F.when(F.col("usable"), packed("numbers")))
    return found.select("id", F.coalesce("id", F.lit(-(1 << 63))).alias("key"), "label", "v")


class Pivots:
    """Pivots of the large groups, by group: names of cells and unit vectors."""

    def __init__(self, groups: dict[int, tuple[list[int], np.ndarray]]):
        self.groups = groups
        self.gaps = {g: np.maximum(np.linalg.norm(u[:, None] - u[None], axis=2), 1e-300) if len(u) <= 256 else None for g, (_, u) in groups.items()}

    def distances(self, group: int, packed: list, kind: str) -> Iterator[tuple[int, np.ndarray]]:
        """Distances of some vectors to all pivots of their group, a few rows at a time: first row, and an array."""
        units = self.groups[group][1]
        step = max(1, DISTANCES // len(units))
        for lo in range(0, len(packed), step):
            own = unit_rows(packed[lo : lo + step], kind)[1]
            yield lo, np.sqrt(np.maximum(2 - 2 * (own @ units.T), 0))

    def guests(self, group: int, distances: np.ndarray, home: np.ndarray, radii: np.ndarray, r: float) -> np.ndarray:
        """For each vector, the cells but its own that may have something within r of it."""
        own = distances[np.arange(len(home)), home][:, None]
        near = (distances - own <= 2 * r + SLACK) & (distances <= radii[None] + r + SLACK)
        rows, cells = np.nonzero(near)
        if len(rows):  # the distance to the bisector of both pivots
            units = self.groups[group][1]
            gap = np.linalg.norm(units[cells] - units[home[rows]], axis=1) if self.gaps[group] is None else self.gaps[group][cells, home[rows]]
            beyond = (distances[rows, cells] ** 2 - own[rows, 0] ** 2) > (2 * gap * (r + SLACK) + SLACK)
            near[rows[beyond], cells[beyond]] = False
        near[np.arange(len(home)), home] = False
        return near


def _pivots(points: DataFrame, kind: str, cell: int) -> tuple[Pivots, DataFrame]:
    """Pivots for the groups of more than `cell` vectors, drawn by a hash; and the sizes of all groups."""
    sizes = stored(points.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("v")).alias("bytes")))
    large = sizes.filter(F.col("n") > cell)
    total = large.agg(F.sum(F.col("n") / cell * F.col("bytes"))).first()[0] or 0
    cell = cell * max(1.0, total / PIVOT_BYTES)
    place = F.pmod(F.xxhash64(F.lit(31), "v"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = points.join(large, "group").filter(place < 1 / F.lit(cell)).select("group", "v")
    groups: dict[int, list[bytes]] = {}
    for row in chosen.toLocalIterator():
        groups.setdefault(row.group, []).append(bytes(row.v))
    return Pivots({g: (list(range(len(v))), unit_rows(sorted(v), kind)[1]) for g, v in groups.items()}), sizes


def range_join(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
               cell: int = CELL) -> DataFrame:
    """Every row of `vectors` as (id, n_links, component_id): how many other rows it links with, and the smallest id reachable.

    Two rows link when their labels are equal and not null, their vectors have one length, and the cosine in
    double precision is at least `cosine` (above 0).  Null, empty and zero vectors and those with null or
    non-finite components link with nothing.  Each row is a vector of its own, so equal rows link with each
    other; a null id comes before all others, and names its component as null.  Other columns are left alone,
    and an empty table gives no rows.  Blocks of large cells are compared each with each, in tasks of their own.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    r = sqrt(2 - 2 * cosine)
    rows = stored(_vectors(vectors, id_column, vector, label))
    distinct = rows.filter("v IS NOT NULL").groupBy("label", "v").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight"))
    # A group is a label and a length.  Its 64-bit name is not relied on: labels are compared with each pair's task.
    points = stored(distinct.select("label", "v", F.xxhash64(F.col("label"), F.octet_length("v")).alias("group"),
                                    F.struct("key", F.xxhash64("label", "v").alias("hash")).alias("node"), "weight"))
    pivots, _ = _pivots(points, kind, cell)
    shared = spark.sparkContext.broadcast(pivots)

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Pivots = shared.value
        for batch in batches:
            groups, vectors = batch["group"].to_numpy(), batch["v"].to_numpy()
            cells, far = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for group in np.unique(groups):
                if group in own.groups:
                    at = np.flatnonzero(groups == group)
                    for lo, distances in own.distances(group, list(vectors[at]), kind):
                        some = at[lo : lo + len(distances)]
                        cells[some], far[some] = distances.argmin(1), distances.min(1)
            yield pd.DataFrame({"group": groups, "cell": cells, "far": far})

    cells = points.select("group", "v").mapInPandas(homes, "group long, cell long, far double").groupBy("group", "cell").agg(F.max("far").alias("far"))
    radii: dict[int, np.ndarray] = {g: np.full(len(names), -np.inf) for g, (names, _) in pivots.groups.items()}
    if radii:
        for row in cells.filter(F.col("group").isin(list(radii))).toLocalIterator():
            radii[row.group][row.cell] = row.far
    limits = spark.sparkContext.broadcast(radii)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Pivots = shared.value
        for batch in batches:
            groups = batch.column("group").to_numpy()
            packed = batch.column("v").to_pylist()
            take, into, home = [], [], []
            for group in np.unique(groups):
                at = np.flatnonzero(groups == group)
                if group not in own.groups:
                    take, into, home = [*take, at], [*into, np.zeros(len(at), np.int64)], [*home, np.ones(len(at), bool)]
                    continue
                for lo, distances in own.distances(group, [packed[i] for i in at], kind):
                    some, nearest = at[lo : lo + len(distances)], distances.argmin(1)
                    i, c = np.nonzero(own.guests(group, distances, nearest, limits.value[group], r))
                    take, into, home = [*take, some, some[i]], [*into, nearest, c], [*home, np.ones(len(some), bool), np.zeros(len(i), bool)]
            if take:
                rows, cells, homes = np.concatenate(take), np.concatenate(into), np.concatenate(home)
                for lo in range(0, len(rows), batch.num_rows):
                    out = batch.take(pa.array(rows[lo : lo + batch.num_rows]))
                    yield out.append_column("cell", pa.array(cells[lo : lo + batch.num_rows])).append_column("home", pa.array(homes[lo : lo + batch.num_rows]))

    columns = ", ".join(f"{f.name if f.name != 'group' else '`group`'} {f.dataType.simpleString()}" for f in points.schema)
    members = stored(points.mapInArrow(placed, f"{columns}, cell bigint, home boolean"))
    blocks = members.groupBy("group", "cell").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / cell).cast("int").alias("own_blocks"), F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("all_blocks"))
    blocks = blocks.filter("own_blocks > 0")
    dealt = members.join(blocks, ["group", "cell"])
    salt = F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(1 << 31))
    sides = dealt.select(
        "label", "v", "node", "weight", "group", "cell", "home", (salt % F.col("own_blocks")).alias("i"), (salt % F.col("all_blocks")).alias("j"), "own_blocks", "all_blocks")
    asks = sides.filter("home").select(*points.columns, "cell", "i", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), F.lit(True).alias("asks"))
    told = sides.select(*points.columns, "cell", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("i"), "j", F.lit(False).alias("asks"))
    node = points.schema["node"].dataType.simpleString()

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        out = [_compared(own, kind, cosine) for _, own in part.groupby("label", sort=False)]
        return pd.concat(out) if len(out) != 1 else out[0]

    tasks = asks.withColumn("i", F.col("i").cast("int")).unionByName(told.withColumn("j", F.col("j").cast("int")))
    found = stored(tasks.select("group", "cell", "i", "j", "label", "v", F.col("node.key").alias("key"), F.col("node.hash").alias("hash"), "weight", "asks")
                   .groupBy("group", "cell", "i", "j").applyInPandas(compare, f"node {node}, links long, root {node}"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    names = components(edges).select("node", F.col("component.key").alias("component"))
    answers = points.join(sums, "node", "left").join(names, "node", "left").filter("links > 0 OR weight > 1").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.least("component", F.col("node.key")).alias("component"))
    joined = rows.join(stored(answers), ["label", "v"], "left")
    component = F.coalesce("component", "key")
    return joined.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(component != -(1 << 63), component).alias("component_id"))


def _compared(part: pd.DataFrame, kind: str, cosine: float) -> pd.DataFrame:
    """Links of the asking vectors of a block pair: sums of weights, and for every linked vector the root of its tree."""
    part = part.sort_values(["key", "hash"]).reset_index(drop=True)
    asks = part["asks"].to_numpy(bool)
    own, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    names = list(zip(part["key"], part["hash"]))
    columns = ["node", "links", "root"]
    if not len(own) or not len(others):
        return pd.DataFrame([], columns=columns)
    # Asking and told rows of one vector are one node, the first of both.
    number, node_of = {}, np.zeros(len(part), np.int64)
    for k, name in enumerate(names):
        node_of[k] = number.setdefault(name, k)
    raw, unit = unit_rows(part["v"], kind)
    weights = part["weight"].to_numpy(np.int64)
    root = np.arange(len(part))
    sums = np.zeros(len(own), np.int64)
    them = node_of[others]
    for lo in range(0, len(own), ROWS):
        rows = own[lo : lo + ROWS]
        links = linked_block((raw[rows], unit[rows]), (raw[others], unit[others]), cosine)
        links &= node_of[rows][:, None] != them[None]
        sums[lo : lo + ROWS] = links @ weights[others]
        for k in np.flatnonzero(links.any(1)):
            mine = node_of[rows[k]]
            trees = np.unique(root[np.append(them[links[k]], mine)])
            if len(trees) > 1:
                root[np.isin(root, trees)] = trees[0]  # the smallest, since rows are in order
    linked = np.flatnonzero(root[node_of] != node_of)
    nodes = {int(node_of[k]): [0, int(root[node_of[k]])] for k in linked}
    for k, n in zip(own, sums):
        if n:
            nodes.setdefault(int(node_of[k]), [0, int(root[node_of[k]])])[0] = int(n)
    return pd.DataFrame([({"key": names[k][0], "hash": names[k][1]}, n, {"key": names[t][0], "hash": names[t][1]}) for k, (n, t) in nodes.items()], columns=columns)


def op12_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of `embeddings`; the smallest id of a component is kept."""
    found = range_join(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op12_near_embeddings": op12_near_embeddings}
SQL = {
    "op12_near_embeddings": f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id"""
}
