"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is WINDOW consecutive words of a benchmark item (a shorter item is one window); it is the set of
its shingles of SHINGLE words with their offsets.  A window occurs in a document only if all its shingles
do, so its rarest one, counted in the documents, is a sufficient prefix.  Documents are joined with these
prefix shingles alone; the offset gives the only place where the window can lie, the document's length
bounds it, and the words there are compared with the window's.

Two scans of the documents: shingle counts (combined before the shuffle), and the join (verified before the
shuffle).  Only occurrences of windows move, and a row for each document.  Where the windows are too many to
be sent to every executor, the hashes of all places move instead, without words, and a third scan compares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import stored, table

WINDOW, SHINGLE = 10, 3
#: Windows and shingles are broadcast up to so many rows (well under 1 kB each), and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: Words, once A-Z have become a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; none of a null."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _shingle(array: Column, at: Column, size: int) -> Column:
    """Hash of `size` words from 0-based `at`.  Null past the end."""
    parts = [F.get(array, at + i) for i in range(size)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(size), *parts))


def windows(items: DataFrame, item_id: str, text: str, window: int, shingle: int) -> DataFrame:
    """Distinct windows: (window words, size, shingle size, items that have it as a sorted array)."""
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(window))
    cut = own.select("item", size.alias("w"), "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - size)).alias("at"))
    cut = cut.select("item", F.slice("ws", F.col("at") + 1, F.col("w")).alias("win"))
    # sorted so that a rerun gives the same array; bounded by the number of items
    grouped = cut.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grouped.select("win", "items", F.size("win").alias("w"), F.least(F.size("win"), F.lit(shingle)).alias("s"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _positions(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """`texts` with a row for each place `pos` and size, with the hash `sh` that begins there; one, without, at the place past the last word.

    The words of a text are cut once, whatever the number of sizes.
    """
    at = texts.select("*", F.explode(F.sequence(F.lit(0), F.size("ws"))).alias("pos"))
    hashes = [_shingle(F.col("ws"), F.col("pos"), s) for s in sizes]
    if len(hashes) == 1:
        return at.withColumn("sh", hashes[0])
    each = at.select("*", F.posexplode(F.array(*hashes)).alias("k", "sh"))
    return each.filter(F.col("sh").isNotNull() | ((F.col("k") == 0) & (F.col("pos") == F.size("ws")))).drop("k")


def _met_in_place(texts: DataFrame, prefix: DataFrame, sizes: list[int], with_documents: bool) -> DataFrame:
    """Places of windows where `prefix` goes to every executor: words are compared where the text is."""
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("w") <= F.size("ws"))
    found = fits & (F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("w")) == F.col("win"))
    if with_documents:
        found = F.coalesce(found, F.lit(False)) | (F.col("pos") == F.size("ws"))
    met = _positions(texts, sizes).join(F.broadcast(prefix), "sh", "left" if with_documents else "inner").filter(found)
    return met.select("doc_id", "text_hash", F.size("ws").alias("n_words"), start.alias("start"), "w", "items")


def _met_by_shuffle(texts: DataFrame, prefix: DataFrame, sizes: list[int], with_documents: bool) -> DataFrame:
    """The same for any number of windows.  Hashes meet the prefixes without the words of their text; what fits goes
    back to its text, once a document, and is compared there.  Texts of one id and hash share what fits, which the
    comparison then tells apart."""
    at = _positions(texts, sizes).filter(F.col("sh").isNotNull())
    at = at.select("doc_id", "text_hash", F.size("ws").alias("n_words"), "pos", "sh")
    met = at.join(prefix, "sh").withColumn("start", F.col("pos") - F.col("offset"))
    met = met.filter((F.col("start") >= 0) & (F.col("start") + F.col("w") <= F.col("n_words")))
    met = met.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set(F.struct("start", "w", "win", "items")).alias("met"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    own = texts.join(met, same, "left" if with_documents else "inner")
    equal = F.filter("met", lambda m: F.slice("ws", m["start"] + 1, m["w"]) == m["win"])
    places = F.transform(equal, lambda m: F.struct(m["start"].alias("start"), m["w"].alias("w"), m["items"].alias("items")))
    if with_documents:
        none = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("w"), F.lit(None).cast("array<string>").alias("items"))
        places = F.concat(F.array(none), F.coalesce(places, F.array().cast("array<struct<start:int,w:int,items:array<string>>>")))
    each = own.select("doc_id", "text_hash", F.size("ws").alias("n_words"), F.explode(places).alias("p"))
    return each.select("doc_id", "text_hash", "n_words", "p.start", "p.w", "p.items")


def _placed(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int, shingle: int,
            with_documents: bool) -> DataFrame:
    """(doc_id, text_hash, n_words, start, w, items) for each place of a window; `with_documents` adds a row without
    start for each document row, so that one scan gives both."""
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), words(F.col(text)).alias("ws"))
    known = stored(windows(items, item_id, item_text, window, shingle).withColumn("id", F.xxhash64("win")))
    sizes = [r[0] for r in known.select("s").distinct().collect()] or [shingle]  # up to `shingle` values
    places = known.select("win", "id", "w", "s", F.explode(F.sequence(F.lit(0), F.col("w") - F.col("s"))).alias("offset"))
    shingles = None
    for s in sizes:
        own = places.filter(F.col("s") == s).select("id", "offset", _shingle(F.col("win"), F.col("offset"), s).alias("sh"))
        shingles = own if shingles is None else shingles.union(own)
    shingles = stored(shingles)
    n = shingles.count()

    wanted, hashes = shingles.select("sh").distinct(), _positions(texts, sizes).select("sh")
    if n <= BROADCAST_ROWS:
        counts = hashes.join(F.broadcast(wanted), "sh").groupBy("sh").count()
    else:  # counted within each task first, so that no frequent shingle is a hot key of the join
        counts = hashes.filter(F.col("sh").isNotNull()).groupBy("sh").count().join(wanted, "sh")
    # the rarest shingle of each window; a window with a shingle that no document has cannot occur
    ranked = shingles.join(_small(counts, n), "sh", "left").groupBy("id").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "sh", "offset")).alias("rarest"))
    prefix = stored(known.join(_small(ranked.filter("rarest.count > 0"), n), "id").select(
        F.col("rarest.sh").alias("sh"), F.col("rarest.offset").alias("offset"), "win", "w", "items"))
    return (_met_in_place if n <= BROADCAST_ROWS else _met_by_shuffle)(texts, prefix, sizes, with_documents)


def occurrences(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Where windows lie in documents: (doc_id, text_hash, start, w, items), once per place and window."""
    return _placed(documents, items, doc_id, text, item_id, item_text, window, shingle, False).drop("n_words")


def contamination(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit.  Null and wordless texts have 0 of all; items without
    words have no window; an item that repeats counts once; an item without id has the empty id.  Rows that
    repeat get equal results each.  Other columns of either table are not looked at.
    """
    found = _placed(documents, items, doc_id, text, item_id, item_text, window, shingle, True)
    place = F.when(F.col("start").isNotNull(), F.struct("start", "w"))
    spans = F.transform(F.collect_set(place), lambda x: F.sequence(x["start"], x["start"] + x["w"] - 1))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    own = found.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").cast("long").alias("n_words"), F.count_if(F.col("start").isNull()).alias("rows"),
        F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"), ids.alias("ids"))
    each = own.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "text_hash", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


QUERIES = {"op7_decontamination": op7_decontamination}

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
SQL = {
    "op7_decontamination": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
cut AS (SELECT item, ws, least(len(ws), {WINDOW}) AS w FROM b WHERE len(ws) > 0),
win AS MATERIALIZED (SELECT DISTINCT item, w, array_to_string(ws[i:i + w - 1], ' ') AS win
    FROM (SELECT item, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM cut)),
place AS (SELECT doc_id, w, i, array_to_string(ws[i:i + w - 1], ' ') AS win
    FROM (SELECT doc_id, ws, s.w, unnest(range(1, len(ws) - s.w + 2)) AS i FROM d, (SELECT DISTINCT w FROM win) s WHERE len(ws) >= s.w)),
hit AS MATERIALIZED (SELECT doc_id, i, place.w, item FROM place JOIN win USING (win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + w)) AS p FROM hit) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
