"""Similar documents: the Jaccard join of word-shingle sets, as components of links.

Equal sets are one class.  A merged sketch orders shingles by rarity (single ones first, then by the power
of two of their count, then by hash); two classes can link only if they share a shingle of their prefixes,
so each class enters the inverted lists of its prefix, with its position there.  Single shingles enter none.

Set relations save the rest.  First every class is compared with one leader only, the one that leads most of
its lists, and its exact overlap is kept; most near copies are settled so.  Then lists whose classes all lie
in one component are skipped whole, and in the others a class is met only by classes of other components:
entries are blocked by set size, and blocks, then entries, are skipped by bounds on what they can share: from
sizes, positions and single shingles, and, for a common leader, from the answers already known: two sets
share of the leader what the one shares but for what the other lacks (64 hashed bits say how much at
least), and outside the leader only what is not single.  What remains is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tablewright.llm.common import lean, small_batches, stored, table, utf8
from tablewright.llm.components import components
from tablewright.llm.sketch import Repeats, build_repeats, fits, with_levels
from tablewright.llm.wordhash import mix, run_hashes, word_hashes

SHINGLE = 5
#: Similarity in hundredths, so that it is compared in whole numbers.
SIMILARITY = 75
#: Ids are sent to every executor up to so many, 16 bytes each.
BROADCAST_IDS = 1_000_000


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` lower-cased words; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < size:
        return mix(run_hashes(hashes, len(words)), len(words))
    return np.unique(run_hashes(hashes, size))


def _needed(n: Column, share: float) -> Column:
    """Length of the prefix of n shingles in which one of ceil(share * n) shared ones must lie."""
    return n - F.ceil(n * F.lit(share) - F.lit(1e-9)) + 1


PREFIX = "key long, n long, set_key binary, single int, shingles array<long>"


def _prefix(key: int, own: np.ndarray, level: np.ndarray, similarity: int) -> tuple:
    """The set's size and digest, the number of its single shingles, and its prefix without them."""
    n = len(own)
    if not n:
        return key, 0, None, 0, []
    single = int(np.count_nonzero(level == 0))
    prefix = n - -(-similarity * n // 100) + 1
    order = np.lexsort((own, level))[single:prefix]
    return key, n, xxh3_128_digest(own.tobytes()), single, own[order].view(np.int64)


def _prefixes(rows: DataFrame, size: int, similarity: int, repeats) -> DataFrame:
    """Rows of PREFIX, by a sketch that every worker gets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Repeats = repeats.value
        for batch in batches:
            sets = (shingle_set(text, size) for text in utf8(batch["text"]))
            out = [_prefix(key, own, found.level(own), similarity) for key, own in zip(batch["key"], sets)]
            yield pd.DataFrame(out, columns=["key", "n", "set_key", "single", "shingles"])

    return rows.mapInPandas(lean(run, repeats), PREFIX)


def _answered_prefixes(rows: DataFrame, size: int, similarity: int, expected: int) -> DataFrame:
    """Rows of PREFIX, by a sketch that is too large for a worker and answers instead."""

    def use(batch: pd.DataFrame, sets: list[np.ndarray], levels: list[np.ndarray]) -> pd.DataFrame:
        out = [_prefix(key, own, level, similarity) for key, own, level in zip(batch["key"], sets, levels)]
        return pd.DataFrame(out, columns=["key", "n", "set_key", "single", "shingles"])

    return with_levels(rows, lambda b: [shingle_set(t, size) for t in utf8(b["text"])], use, PREFIX, expected)


def _sets(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["key"], "set": [shingle_set(t, size).view(np.int64) for t in utf8(batch["text"])]})

    return rows.mapInPandas(lean(run), "id long, set array<long>")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their sets and of the intersection, and what a lacks of b as 64 bits."""
    left, right = sets.withColumnsRenamed({"id": "a", "set": "set_a"}), sets.withColumnsRenamed({"id": "b", "set": "set_b"})
    both = pairs.join(left, "a").join(right, "b")
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    lacks = F.aggregate(F.array_except("set_b", "set_a"), F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(one(h)))
    return both.select("a", "b", F.size("set_a").alias("na"), F.size("set_b").alias("nb"),
                       F.size(F.array_intersect("set_a", "set_b")).alias("shared"), lacks.alias("lacks"))


def _links(overlaps: DataFrame, similarity: int) -> DataFrame:
    return overlaps.filter(100 * F.col("shared") >= similarity * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def similar_components(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """Per document row: doc_id, n_shingles, class_id, component_id.

    A class is the documents of equal sets, named by its smallest doc_id; a component, named likewise, is
    what links of similarity `similarity` / 100 or more connect.  Null and wordless texts have no shingle and
    are alone.  Rows that repeat get equal results; of rows that share a doc_id with different texts each
    keeps its own size and class, and a class id shared by two sets joins them.  A null doc_id is taken as
    the smallest.  Other columns are not looked at.  Shingles are told apart by 64-bit hashes.
    """
    spark = documents.sparkSession
    small_batches(spark)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    rows = documents.select(key.alias("key"), F.col(text).alias("text"))
    characters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    expected = int(characters) // 6
    if fits(expected):
        repeats = build_repeats(rows.select("text"), lambda b: np.concatenate([shingle_set(t, size) for t in utf8(b["text"])]), expected)
        repeats = spark.sparkContext.broadcast(repeats)
        known = stored(_prefixes(rows, size, similarity, repeats))
        repeats.unpersist()  # workers that stay need not keep the sketch
    else:
        known = stored(_answered_prefixes(rows, size, similarity, expected))
    classes = stored(known.filter("n > 0").groupBy("set_key").agg(
        F.min("key").alias("id"), F.min("n").alias("n"), F.min("single").alias("single"), F.min("shingles").alias("shingles")))
    share = similarity / 100
    entries = classes.select("id", "n", F.posexplode("shingles").alias("pos", "shingle"), "single").select(
        "shingle", "id", "n", "single", (F.col("pos") + F.col("single")).alias("pos"))
    # lists of one class lead nowhere
    lists = entries.groupBy("shingle").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader < last").select("shingle", "leader")
    entries = stored(entries.join(lists, "shingle"))

    ids = entries.select("id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = stored(_sets(rows.join(ids, rows.key == ids.id).select("key", "text"), size).groupBy("id").agg(F.min("set").alias("set")))

    # one comparison for each class: with the class that leads most of its lists
    led = entries.filter("leader <> id").groupBy("id", "leader").count().groupBy("id").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    answers = stored(_overlaps(led.select(F.col("id").alias("a"), F.col("leader").alias("b")), sets))
    settled = stored(_links(answers, similarity))
    place = components(settled).withColumnsRenamed({"node": "id", "component": "part"})
    led_to = answers.select(F.col("a").alias("id"), F.col("b").alias("led_by"), F.col("shared").alias("led"), "lacks")
    entries = entries.drop("leader").join(place, "id", "left").withColumn("part", F.coalesce("part", "id")).join(led_to, "id", "left")
    entries = stored(entries.withColumn("block", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / share)).cast("int")))

    # lists within one component are skipped; in the others the part with most entries does not meet itself
    parts = entries.groupBy("shingle", "part").count()
    mixed = parts.groupBy("shingle").agg(F.max_by("part", F.struct("count", -F.col("part"))).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("shingle", "main")
    entries = stored(entries.join(mixed, "shingle"))
    probes = entries.filter("part <> main").select("shingle", *[F.col(c).alias(f"p_{c}") for c in ("id", "n", "single", "pos", "part", "led_by", "led", "lacks", "block")])
    probes = probes.withColumn("block", F.explode(F.array(F.col("p_block") - 1, F.col("p_block"), F.col("p_block") + 1)))
    need = F.ceil((F.col("n") + F.col("p_n")) * F.lit(share / (1 + share)) - F.lit(1e-9))
    shorter = F.when(F.col("n") < F.col("p_n"), F.col("pos") < _needed(F.col("n"), 2 * share / (1 + share)))
    shorter = shorter.when(F.col("n") > F.col("p_n"), F.col("p_pos") < _needed(F.col("p_n"), 2 * share / (1 + share))).otherwise(F.lit(True))
    beyond = F.least(F.col("n") - F.col("led") - F.col("single"), F.col("p_n") - F.col("p_led") - F.col("p_single"))
    # of the leader's shingles that one set has, those are not shared that the other lacks
    lost = lambda other, own: F.bit_count(F.col(other).bitwiseAND(F.bitwise_not(F.col(own))))
    within = F.least(F.col("led") - lost("p_lacks", "lacks"), F.col("p_led") - lost("lacks", "p_lacks"))
    possible = (
        (F.col("part") != F.col("p_part"))
        & ((F.col("part") == F.col("main")) | (F.col("id") < F.col("p_id")))  # else both sides probe
        & (F.least("n", "p_n") * 100 >= similarity * F.greatest("n", "p_n"))
        & (F.least(F.col("n") - F.col("pos"), F.col("p_n") - F.col("p_pos")) + F.least(F.col("pos") - F.col("single"), F.col("p_pos") - F.col("p_single")) >= need)
        & shorter
        & ~F.coalesce((F.col("led_by") == F.col("p_led_by")) & (within + beyond < need), F.lit(False))
    )
    pairs = probes.join(entries, ["shingle", "block"]).filter(possible).select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct()
    pairs = pairs.join(answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = _links(_overlaps(pairs, sets), similarity)
    whole = components(settled.union(more)).withColumnsRenamed({"node": "id", "component": "component_id"})

    named = classes.select("set_key", "id").join(whole, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    own = known.join(named, "set_key", "left")
    back = lambda c: F.when(F.col(c) == -(1 << 63), None).otherwise(F.col(c))
    return own.select(back("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("id", "key").alias("class_id"),
                      F.coalesce("component_id", "key").alias("component_id"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


QUERIES = {"op2_jaccard": op2_jaccard}
SQL: dict[str, str] = {}
