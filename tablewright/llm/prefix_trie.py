"""Prefix tries of conversations, as balanced parentheses a shard, merged along the spines that shards share.

A conversation is the sequence of its turns' 128-bit hashes; texts are left behind at once.  Distinct
sequences are range-partitioned in order of their bytes, so a shard is a run of a depth-first walk and its
trie is written as balanced parentheses while the sequences stream by.  Blocks of the parentheses' excess
under a min-max tree find each node's closing parenthesis; with it, ranks of leaf pairs and cumulative
arrays give a subtree's leaves and savings as differences.  Only nodes on the path to the last sequence of
one shard and the first of the next, a spine, lie in several shards: their parts are added up.  Each node
belongs to the first shard that has it, which alone counts it as a child, a leaf and against the savings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches, stored, table
from tablewright.llm.turns import crc32_sql

#: Bytes of a turn's hash in a sequence, and of its word count.
WIDTH, COUNT = 16, 4
#: Parentheses of a block of the excess.
BLOCK = 64
#: Turns of sequences that a shard should have.
SHARD_TURNS = 2_000_000
#: Spine nodes are sent to every executor up to so many, and joined by shuffle beyond.
BROADCAST_NODES = 200_000

NOTHING = hashlib.sha256(b"").hexdigest()


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turns, words): a conversation's hashes and word counts as bytes, from its rows in order."""
    names = ["conv_id", "turns", "words"]
    current, turns, words = None, [], []
    for batch in batches:
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        hashes = np.stack([batch.column(k).to_numpy() for k in (1, 2)], 1).astype(">i8").tobytes()
        counts = batch.column(3).to_numpy().astype(">i4").tobytes()
        edges = np.flatnonzero(np.diff(conv)) + 1
        out = []
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(conv)]):
            if hi > lo:
                if current is not None and conv[lo] != current:
                    out.append((current, b"".join(turns), b"".join(words)))
                    turns, words = [], []
                current = int(conv[lo])
                turns.append(hashes[lo * WIDTH : hi * WIDTH])
                words.append(counts[lo * COUNT : hi * COUNT])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([b"".join(turns)]), pa.array([b"".join(words)])], names)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, words) of every conversation: a hash and a word count for each turn, one after another.

    Order is by turn, nulls first, rows of one turn by a hash of role and text; null roles and texts count as
    empty; rows without conv_id belong to no conversation and are left out.  A conversation's hashes, not its
    texts, meet in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("n"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "a", "b")
    return rows.select("conv_id", "a", "b", "n").mapInArrow(_assembled, "conv_id long, turns binary, words binary")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(turns, words, first, n, sha): distinct sequences with their conversations, from rows in order of (turns, conv_id)."""
    names = ["turns", "words", "first", "n", "sha"]
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string())
    key, own, first, n, running = None, None, 0, 0, None
    for batch in batches:
        out = []
        for turns, words, conv in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if turns != key:
                if running is not None:
                    out.append((key, own, first, n, running.hexdigest()))
                key, own, first, n, running = turns, words, conv, 1, hashlib.sha256(b"%d" % conv)
            else:
                n += 1
                running.update(b",%d" % conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((key, own, first, n, running.hexdigest()), kinds)], names)


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences share from the start."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    x, y = (np.frombuffer(s, np.uint8, n * WIDTH) for s in (a, b))
    return int(np.argmax(x != y)) // WIDTH


class Parentheses:
    """A trie as parentheses: 1 opens a node, 0 closes it.  Answers come for all nodes at once."""

    def __init__(self, bits: np.ndarray):
        self.opens = np.flatnonzero(bits)
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int32) * 2 - 1, dtype=np.int32)
        size = -(-len(bits) // BLOCK)
        padded = np.full(size * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(bits)] = self.excess
        level = padded.reshape(size, BLOCK).min(1)
        level = np.append(level, np.full((1 << max(size - 1, 0).bit_length()) - size, np.iinfo(np.int32).max, np.int32))
        self.levels = [level]  # least excess of blocks, of pairs of blocks, and so on to the whole
        while len(level) > 1:
            level = level.reshape(-1, 2).min(1)
            self.levels.append(level)

    def find_close(self) -> np.ndarray:
        """The closing place of every opening one: the next where the excess is below that before the node."""
        target = self.excess[self.opens] - 1
        found = np.full(len(self.opens), -1, np.int64)
        self._scan(self.opens + 1, self.opens // BLOCK * BLOCK + BLOCK, target, found, np.arange(len(found)))
        left = np.flatnonzero(found < 0)
        node, height = self.opens[left] // BLOCK, np.zeros(len(left), np.int64)
        at = np.full(len(left), -1, np.int64)
        climbing = np.arange(len(left))
        for k in range(len(self.levels) - 1):  # up, until a right neighbour holds the excess
            own = node[climbing]
            right = (own & 1 == 0) & (self.levels[k][own | 1] <= target[left[climbing]])
            at[climbing[right]], height[climbing[right]] = own[right] | 1, k
            climbing = climbing[~right]
            node[climbing] >>= 1
        for k in range(len(self.levels) - 1, 0, -1):  # and down to its first block
            down = np.flatnonzero(height == k)
            child = at[down] * 2
            at[down] = child + (self.levels[k - 1][child] > target[left[down]])
            height[down] = k - 1
        self._scan(at * BLOCK, at * BLOCK + BLOCK, target[left], found, left)
        return found

    def _scan(self, start: np.ndarray, stop: np.ndarray, target: np.ndarray, found: np.ndarray, where: np.ndarray) -> None:
        stop = np.minimum(stop, len(self.excess))
        live = np.arange(len(start))
        place = start.copy()
        while len(live):
            live = live[place[live] < stop[live]]
            hit = self.excess[place[live]] == target[live]
            found[where[live[hit]]] = place[live[hit]]
            live = live[~hit]
            place[live] += 1


def shard_nodes(rows: list[tuple[bytes, bytes, int, int, str]], before: int, after: int) -> dict[str, list]:
    """The nodes of a shard: of the trie of its distinct sequences (turns, words, first conversation, number, digest), in order.

    `before` and `after` are the turns that the first sequence shares with the last of the shard before and the
    last one with the first of the next, -1 where there is none.  Nodes that lie in other shards too have a
    `spine` digest; what is counted of them here is this shard's part.
    """
    depths, parents, bits, counts, firsts, ends, words = [0], [-1], [1], [0], [None], [NOTHING], [0]
    path, last = [0], b""
    for turns, own_words, first, n, sha in rows:
        shared, size = common_turns(last, turns), len(turns) // WIDTH
        bits += [0] * (len(path) - 1 - shared)
        del path[shared + 1 :]
        fresh = list(range(len(depths), len(depths) + size - shared))
        depths += range(shared + 1, size + 1)
        parents += [path[-1], *fresh[:-1]] if fresh else []
        path += fresh
        bits += [1] * len(fresh)
        counts += [0] * len(fresh)
        firsts += [None] * len(fresh)
        ends += [NOTHING] * len(fresh)
        words += np.frombuffer(own_words, ">i4")[shared:].tolist()
        node, last = path[-1], turns
        counts[node], firsts[node], ends[node] = n, first, sha
    bits += [0] * len(path)
    trie = Parentheses(np.array(bits, np.int8))
    opens, closes = trie.opens, trie.find_close()
    size = (closes - opens + 1) // 2
    nodes = np.arange(len(opens))
    depths, parents, counts, words = (np.array(x, np.int64) for x in (depths, parents, counts, words))
    tip = path[-1]

    spine = np.zeros(len(nodes), bool)
    first_path = nodes[: len(rows[0][0]) // WIDTH + 1]  # the first sequence opens the walk
    owned = np.ones(len(nodes), bool)
    if before >= 0:
        spine[first_path[: before + 1]] = True
        owned[first_path[: before + 1]] = False
    if after >= 0:
        spine[path[: after + 1]] = True

    leaf = np.append(trie.bits[1:] == 0, False) & (trie.bits == 1)  # pairs "()"
    if after == depths[tip]:
        leaf[opens[tip]] = False  # the next shard goes on from here
    ranks = np.concatenate(([0], np.cumsum(leaf)))
    summed = lambda values: np.concatenate(([0], np.cumsum(values)))
    members = (lambda c: c[nodes + size] - c[nodes])(summed(counts))
    saved = (lambda c: c[nodes + size] - c[nodes])(summed(members * words - owned * words))
    least = np.array([np.iinfo(np.int64).max if f is None else f for f in firsts], np.int64)
    for node in nodes[:0:-1]:
        if least[node] < least[parents[node]]:
            least[parents[node]] = least[node]

    keys: list[bytes | None] = [None] * len(nodes)
    for turns, own, shared in ((rows[0][0], first_path, before), (last, path, after)):
        digest = hashlib.blake2b(digest_size=16)
        for depth in range(shared + 1):
            keys[own[depth]] = digest.copy().digest()
            digest.update(turns[depth * WIDTH : (depth + 1) * WIDTH])
    above = [None if p < 0 else keys[p] for p in parents.tolist()]
    parent_first = np.where(parents < 0, 0, least[parents])
    return {
        "spine": keys, "above": above, "conv_id": least.tolist(), "depth": depths.tolist(),
        "parent_conv_id": [None if p < 0 or k is not None else x for p, k, x in zip(parents.tolist(), above, parent_first.tolist())],
        "n_convs": members.tolist(), "n_children": np.bincount(parents[1:], owned[1:], len(nodes)).astype(np.int64).tolist(),
        "n_leaves": (ranks[closes] - ranks[opens]).tolist(), "saved_tokens": saved.tolist(), "ends_sha256": ends,
    }


_NODE = pa.schema([("spine", pa.binary()), ("above", pa.binary()), *((n, pa.int64()) for n in (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())])
_NODE_SQL = ("spine binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
             "n_leaves long, saved_tokens long, ends_sha256 string")


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each shard, from rows (shard, before, after, turns, words, first, n, sha) in order."""

    def nodes(rows: list, before: int, after: int) -> Iterator[pa.RecordBatch]:
        made = pa.RecordBatch.from_pydict(shard_nodes(rows, before, after), _NODE)
        for lo in range(0, made.num_rows, 50_000):
            yield made.slice(lo, 50_000)

    shard, rows, sides = None, [], (-1, -1)
    for batch in batches:
        for own, before, after, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if own != shard and rows:
                yield from nodes(rows, *sides)
                rows = []
            shard, sides = own, (before, after)
            rows.append(tuple(row))
    if rows:
        yield from nodes(rows, *sides)


def prefix_trie(sequences: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of `sequences` (conv_id, turns, words): one row for each distinct beginning.

    conv_id (the smallest with that beginning) and depth name a node; parent_conv_id, n_convs, n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (words that sharing the subtree's turns saves) and
    ends_sha256 (the conversations that end there).  An empty table has no nodes.  Rows with one conv_id count
    as so many conversations.  Shards hold about SHARD_TURNS turns.  The conversations of one sequence pass
    through one task, as their digest demands, without being held there.
    """
    rows = stored(sequences)
    if shards is None:
        turns = rows.agg(F.sum(F.octet_length("turns"))).first()[0] or 0
        shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // (WIDTH * SHARD_TURNS)))
    ordered = rows.select("turns", "words", "conv_id").repartitionByRange(shards, "turns").sortWithinPartitions("turns", "conv_id")
    distinct = stored(ordered.mapInArrow(_distinct, "turns binary, words binary, first long, n long, sha string").withColumn("shard", F.spark_partition_id()))

    share = F.udf(lambda a, b: -1 if a is None or b is None else common_turns(a, b), "int")  # a row a shard
    ends = distinct.groupBy("shard").agg(F.min("turns").alias("head"), F.max("turns").alias("tail"))
    order = Window.orderBy("shard")
    sides = ends.select("shard", "head", "tail", F.lag("tail").over(order).alias("old"), F.lead("head").over(order).alias("new"))
    sides = stored(sides.select("shard", share("old", "head").alias("before"), share("tail", "new").alias("after")))
    placed = distinct.join(F.broadcast(sides), "shard").select("shard", "before", "after", "turns", "words", "first", "n", "sha")
    placed = placed.repartition(shards, "shard").sortWithinPartitions("shard", "turns")
    nodes = stored(placed.mapInArrow(_tries, _NODE_SQL))

    whole = stored(nodes.filter("spine IS NOT NULL").groupBy("spine", "depth").agg(
        F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256"))), F.lit(NOTHING)).alias("ends_sha256")))
    inner = nodes.filter("spine IS NULL").drop("spine")
    every = whole.drop("spine").withColumn("parent_conv_id", F.lit(None).cast("long")).select(inner.columns).union(inner)
    parents = whole.select(F.col("spine").alias("above"), F.col("conv_id").alias("__parent"))
    if whole.count() <= BROADCAST_NODES:
        parents = F.broadcast(parents)
    return every.join(parents, "above", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "__parent").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation c behind the first crc32(c) % 4 turns of conversation c - c % 20, as the query prescribes."""
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")})
    heads = own.filter("conv_id = base").select(
        F.col("conv_id").alias("base"), F.expr(f"substring(turns, 1, {3 * WIDTH})").alias("t"), F.expr(f"substring(words, 1, {3 * COUNT})").alias("w"))
    cut = lambda column, head, width: F.expr(
        f"concat(coalesce(substring({head}, 1, {width} * h), X''), substring({column}, {width} * h + 1, octet_length({column})))")
    return own.join(heads, "base", "left").select("conv_id", cut("turns", "t", WIDTH).alias("turns"), cut("words", "w", COUNT).alias("words"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    small_batches(spark)
    return prefix_trie(rebuilt(stored(sequences(table(spark, sf_dir, "conversations")))))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
SQL = {
    "op11_prefix_trie": f"""
WITH turns AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT *, {crc32_sql("c::VARCHAR")} % 4 AS h FROM turns),
seq AS MATERIALIZED (SELECT a.c, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS s FROM hashed a LEFT JOIN turns b ON b.c = a.c - a.c % 20),
begun AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seq),
node AS MATERIALIZED (SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '') AS ends,
        len(regexp_extract_all(coalesce(any_value(s[d].t), ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM begun GROUP BY p, d),
child AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
known AS MATERIALIZED (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child USING (p)),
above AS (SELECT p[1:k] AS p, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE w END)::BIGINT AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM known) GROUP BY 1)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM known a JOIN above USING (p) LEFT JOIN known b ON a.d > 0 AND b.d = a.d - 1 AND b.p = a.p[1:a.d - 1]"""
}
