"""From raw documents to token ids: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage but the last returns the columns of `documents`.  A stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, jaccard, quality_net, segment, substring
from tablewright.llm.common import small_batches, stored, table
from tablewright.llm.pieces import MODEL_PATH, read_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Keys of documents to drop are sent to every executor up to so many, and joined by shuffle beyond.
BROADCAST_KEYS = 1_000_000


def _without(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `docs` whose keys, null-safe, are not in `dropped`."""
    dropped = stored(dropped)
    marked = dropped.select([F.col(k).alias(f"__gone_{k}") for k in keys])
    if dropped.count() <= BROADCAST_KEYS:
        marked = F.broadcast(marked)
    same = [docs[k].eqNullSafe(marked[f"__gone_{k}"]) for k in keys]
    return docs.join(marked, same, "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject.  It learns from those outside the held-out fold."""
    small_batches(spark)
    net = quality_net.fit(docs, table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).filter(quality_net.quality_score(F.col("text"), net) >= quality_net.CUT)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of similar ones; null ids come first, rows of one id by a hash of their text.

    Where ids are missing or repeat, rows are told apart by id and text; of rows equal in both the least stays.
    """
    own = docs.select(*COLUMNS)
    if own.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        found = stored(jaccard.similar_components(own))
        return _without(own, found.filter("component_id <> doc_id").select("doc_id"), ["doc_id"])
    rest = F.struct("lang", "source", "n_chars", "text")
    own = stored(own.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.min(rest).alias("row")).select("doc_id", "text_hash", "row.*"))
    order = ["doc_id", "text_hash"]
    placed = stored(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    found = stored(jaccard.similar_components(placed, "place"))
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("place"))
    return _without(placed, gone, ["place"]).select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents; a text that loses nothing stays as it is, one that loses all goes."""
    cut = substring.without_repeats(docs.select(*COLUMNS)).filter("dedup.n_removed = 0 or dedup.n_removed < dedup.n_words")
    text = F.when(F.col("dedup.n_removed") > 0, F.col("dedup.kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("dedup.n_removed") > 0, F.char_length("dedup.kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    own = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    hits = decontaminate.occurrences(own.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _without(own, hits.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"]).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their best segmentation, the scores of the N best, and the others' changes."""
    small_batches(spark)
    coded = docs.select(*COLUMNS, segment.encode_pieces(F.col("text"), read_model(MODEL_PATH)).alias("p"))
    return coded.select(*COLUMNS, F.size("p.ids").alias("n_pieces"), "p.ids", "p.scores", "p.changes")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding", to_pieces),
]

#: Two stages are models in Python, which SQL cannot express; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
