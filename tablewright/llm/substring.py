"""Removal of passages that an earlier document has already, exact, behind a count-min prefilter.

First pass: merged sketches of the hashes of all windows of WINDOW words; they never take a repeated
window for a single one, whether each worker gets the sketch or asks it.  Second pass: windows that may repeat are grouped exactly, combined within each
task first, to the smallest doc_id that has them.  Third pass: the same windows meet that doc_id; those of
later documents become ranges of words, which go back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import give_back, lean, small_batches, stored, table, utf8
from tablewright.llm.sketch import FLUSH, Repeats, build_repeats, fits, with_levels
from tablewright.llm.wordhash import run_hashes, word_hashes

WINDOW = 13
#: Ranges are sent to every executor while they take less than this; beyond, texts and ranges are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Exact copies keep out of the search for windows while their ids can be sent to every executor.
BROADCAST_COPIES = 1_000_000
#: Bytes of texts that a worker gets at once, beside its sketch.
BATCH = 2 << 20
#: The end of a range that takes a whole text.
ALL = (1 << 31) - 1


def _windows(texts, window: int) -> list[np.ndarray]:
    """Hashes of the windows of each text."""
    return [run_hashes(word_hashes(t.split()), window) for t in utf8(texts)]


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def _first_documents(rows: DataFrame, window: int, repeats) -> DataFrame:
    """(h, first): windows of two or more documents, with the smallest doc_id.  Tasks send a window once a flush."""

    def combined(hashes: np.ndarray, docs: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((docs, hashes))
        hashes, docs = hashes[order], docs[order]
        edge = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        last = np.append(edge[1:], len(hashes)) - 1
        return pd.DataFrame({"h": hashes[edge].view(np.int64), "lo": docs[edge], "more": docs[last] > docs[edge]})

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Repeats = repeats.value
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for batch in batches:
            own = _windows(batch["text"], window)
            hashes, docs = np.concatenate(own), np.repeat(batch["key"].to_numpy(), [len(h) for h in own])
            keep = found(hashes)
            waiting.append((hashes[keep], docs[keep]))
            total += int(keep.sum())
            if total >= FLUSH:
                yield combined(*map(np.concatenate, zip(*waiting)))
                waiting, total = [], 0
                give_back()
        if total:
            yield combined(*map(np.concatenate, zip(*waiting)))

    sent = rows.mapInPandas(lean(send, repeats), "h long, lo long, more boolean")
    seen = sent.groupBy("h").agg(F.min("lo").alias("first"), F.max("lo").alias("last"), F.bool_or("more").alias("more"))
    return seen.filter("first < last or more").select("h", "first")


def _occurrences(rows: DataFrame, window: int, repeats) -> DataFrame:
    """(h, key, t1, at): places of the windows that may repeat."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Repeats = repeats.value
        for batch in batches:
            own = _windows(batch["text"], window)
            lengths = [len(h) for h in own]
            hashes = np.concatenate(own)
            docs, texts = (np.repeat(batch[c].to_numpy(), lengths) for c in ("key", "t1"))
            at = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keep = found(hashes)
            yield pd.DataFrame({"h": hashes[keep].view(np.int64), "key": docs[keep], "t1": texts[keep], "at": at[keep].astype(np.int32)})

    return rows.mapInPandas(lean(send, repeats), "h long, key long, t1 long, at int")


def _repeated_places(rows: DataFrame, window: int, expected: int) -> DataFrame:
    """As `_occurrences`, with a sketch that is too large for a worker and answers instead."""

    def keep(batch: pd.DataFrame, own: list[np.ndarray], levels: list[np.ndarray]) -> pd.DataFrame:
        at = [np.flatnonzero(level) for level in levels]
        docs, texts = (np.repeat(batch[c].to_numpy(), [len(a) for a in at]) for c in ("key", "t1"))
        h = np.concatenate([hashes[a] for hashes, a in zip(own, at)]).view(np.int64)
        return pd.DataFrame({"h": h, "key": docs, "t1": texts, "at": np.concatenate(at).astype(np.int32)})

    return with_levels(rows, lambda b: _windows(b["text"], window), keep, "h long, key long, t1 long, at int", expected)


def _merged(starts: np.ndarray, window: int) -> list[int]:
    """Disjoint ranges of words, as start, end, start, end, ..., that windows at `starts` cover."""
    starts = np.unique(starts)
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + window)))
    ends = starts[np.append(new[1:], len(starts)) - 1] + window
    return np.stack([starts[new], ends], 1).ravel().tolist()


def _text_key() -> list[Column]:
    """128 bits of the text.  Spark hashes on from what the columns before gave, so the constant of the second comes first."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def _copies(rows: DataFrame) -> DataFrame:
    """(key, t1): rows whose text a smaller key has too, whole."""
    own = rows.select("key", *_text_key())
    first = own.groupBy("t1", "t2").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").drop("last")
    return own.join(first, ["t1", "t2"]).filter("first < key").select("key", "t1").distinct()


def _told_apart(rows: DataFrame) -> DataFrame:
    """`rows` with t1 0 wherever the key alone tells the text: a hash for each place of a window is a lot to shuffle.

    Keys with several texts are looked up while they can be sent to every executor; beyond, all keep their hash.
    """
    twins = stored(rows.groupBy("key").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).filter("a < b").select(F.col("key").alias("__twin")))
    if twins.count() > BROADCAST_COPIES:
        return rows
    marked = rows.join(F.broadcast(twins), F.col("key") == F.col("__twin"), "left")
    return marked.select("key", "text", F.when(F.col("__twin").isNotNull(), F.col("t1")).otherwise(0).alias("t1"))


def repeated_ranges(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, t1, ranges): for each row with such words, by its doc_id and the hash of its text (or 0, for all rows of the
    id), the ranges of words in windows that a smaller doc_id has."""
    spark = documents.sparkSession
    rows = documents.select(_key(doc_id).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("t1")).filter(F.col("text").isNotNull())
    rows = _told_apart(rows)
    copies = stored(_copies(rows))
    apart = copies.count() <= BROADCAST_COPIES
    if apart:  # every window of a copy starts in its first copy, and adds nothing to other documents' answers
        same = copies.select(F.col("key").alias("__key"), F.col("t1").alias("__t1"))
        rows = rows.join(F.broadcast(same), (F.col("key") == F.col("__key")) & (F.xxhash64("text") == F.col("__t1")), "left_anti")
    words = rows.agg(F.sum(F.length("text"))).first()[0] or 0  # at six characters a word
    expected, repeats = int(words) // 6, None
    if fits(expected):
        repeats = build_repeats(rows.select("text"), lambda b: np.concatenate(_windows(b["text"], window)), expected)
        repeats = spark.sparkContext.broadcast(repeats)
        first, places = _first_documents(rows, window, repeats), _occurrences(rows, window, repeats)
    else:
        places = stored(_repeated_places(rows, window, expected))
        first = places.groupBy("h").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").select("h", "first")
    later = places.join(first, "h").filter("first < key").select("key", "t1", "at")

    @F.pandas_udf("array<int>")
    def merge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(lambda own: (pd.Series([_merged(s, window) for s in starts]) for starts in own))(batches)

    ranges = later.groupBy("key", "t1").agg(F.collect_list("at").alias("at")).select("key", "t1", merge("at").alias("ranges"))
    out = stored(ranges.union(copies.select("key", "t1", F.array(F.lit(0), F.lit(ALL)))) if apart else ranges)
    if repeats:
        repeats.unpersist()  # workers that stay need not keep the sketch
    return out


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns of `documents`, and the column `dedup`: n_words, n_removed, kept.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input.  `kept` is the other words joined by one space.  Null and wordless texts
    have no word and an empty `kept`; a null doc_id comes before all others; equal rows do not remove each
    other's words, and of rows that share a doc_id each loses its own.  A column called `dedup` is replaced.
    Windows are told apart by 64-bit hashes.
    """
    small_batches(documents.sparkSession, BATCH)
    ranges = repeated_ranges(documents, doc_id, text, window)
    size = ranges.agg(F.sum(F.size("ranges") * 4 + 40)).first()[0] or 0
    ranges = ranges.withColumnsRenamed({"key": "__dedup_key", "t1": "__dedup_text", "ranges": "__dedup_ranges"})
    if size <= BROADCAST_BYTES:
        ranges = F.broadcast(ranges)

    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for t, own in zip(utf8(texts), ranges):
            words = t.split()
            if own is None or not len(own) or len(words) < window:
                out.append((len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")))
                continue
            kept, at = [], 0
            for start, end in zip(own[0::2], own[1::2]):
                kept += words[at:start]
                at = min(end, len(words))
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from lean(lambda own: (cut(texts, ranges) for texts, ranges in own))(batches)

    same = (_key(doc_id) == F.col("__dedup_key")) & ((F.col("__dedup_text") == 0) | (F.xxhash64(text) == F.col("__dedup_text")))
    joined = documents.join(ranges, same, "left")
    return joined.withColumn("dedup", keep(F.col(text), F.col("__dedup_ranges"))).drop("__dedup_key", "__dedup_text", "__dedup_ranges")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept_sha256"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL = {
    "op10_substring_dedup": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, hash(ws[i:i + {WINDOW - 1}]) AS h
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM d)),
first AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN first USING (h) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)"""
}
