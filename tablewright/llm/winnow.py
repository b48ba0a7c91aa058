"""Document fingerprints by winnowing, in DataFrame operations only.

A text is cut into words (ideographs stand alone).  Every run of GRAM words has a hash, and of every
WINDOW neighbouring hashes the smallest is kept, of equal ones the rightmost, with its position.  So two
texts that share GRAM + WINDOW - 1 words in a row share a fingerprint, and one whose position is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import table

GRAM, WINDOW = 4, 8
#: Ranges of ids for each task of the shuffle: many, so that the tasks come out alike.
RANGES = 8
#: Fixed value: words, and characters of scripts that put no space between words.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]+"
#: Low bits of a packed hash, which hold the position counted from the right: as many as an array can have places.
PLACE_BITS = 31
LAST_PLACE = (1 << PLACE_BITS) - 1


def with_fingerprint(df: DataFrame, text: str, name: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add `name`, the fingerprint as 'position:hash' in order, and `name`_set, its distinct hashes.

    A text of fewer than `gram` words has one hash over all of them; fewer hashes than `window` are one
    window; a text without words, null included, has the empty fingerprint.  Whole texts are used, however long.
    Each step is a column of its own, so that it is computed once.
    """
    t, g, p, m = (f"{name}_{part}" for part in ("tokens", "grams", "packed", "kept"))
    out = df.withColumn(t, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)))
    one = F.when(F.size(t) > 0, F.array(F.xxhash64(t))).otherwise(F.array().cast("array<bigint>"))
    many = F.transform(F.sequence(F.lit(0), F.size(t) - gram), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(gram)]))
    out = out.withColumn(g, F.when(F.size(t) < gram, one).otherwise(many))
    # the upper 32 bits of a hash, then its place from the right: the minimum is the smallest hash, rightmost of equals
    out = out.withColumn(p, F.transform(g, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(F.lit(LAST_PLACE).cast("long") - i)))
    few = F.when(F.size(p) > 0, F.array(F.array_min(p))).otherwise(F.array().cast("array<bigint>"))
    least = F.transform(F.sequence(F.lit(1), F.size(p) - window + 1), lambda i: F.array_min(F.slice(p, i, window)))
    out = out.withColumn(m, F.when(F.size(p) < window, few).otherwise(F.array_distinct(least)))
    place = lambda v: (F.lit(LAST_PLACE) - v.bitwiseAND(F.lit(LAST_PLACE).cast("long"))).cast("int")
    entry = lambda v: F.concat_ws(":", place(v), F.lower(F.hex(F.get(g, place(v)))))
    out = out.withColumn(name, F.concat_ws(" ", F.transform(m, entry)))
    out = out.withColumn(f"{name}_set", F.array_distinct(F.transform(m, lambda v: F.get(g, place(v)))))
    return out.drop(t, g, p, m)


def likeness(a: str, b: str) -> Column:
    """Shared hashes over all hashes of two fingerprint sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def _cuts(documents: DataFrame, parts: int) -> list[int]:
    """First keys of about `parts` equal ranges; all of them occur in the data."""
    shares = [i / parts for i in range(1, parts)] or [0.0]
    row = documents.agg(F.min("key"), F.percentile_approx("key", shares, 20 * max(parts, 500))).first()
    return [] if row[0] is None else sorted({row[0], *row[1]})


def with_next(documents: DataFrame, doc_id: str, text: str, parts: int) -> tuple[DataFrame, W]:
    """Rows as (doc_id, text, next), `next` being the text of the following row by (doc_id, text), round the end.

    The key range is cut into buckets; the first row of each is also sent to the bucket before, so that no
    row's successor lies elsewhere.  One shuffle; no task sees more than a bucket.  Also the window of a bucket.
    Rows with `ghost` set are those copies; they stand last and are to be dropped at the end.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), key.alias("key"))
    cuts = _cuts(rows, parts)
    steps = [1 << k for k in range(max(len(cuts), 1).bit_length() - 1, -1, -1)]
    array = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    # binary search: how many cuts are at or under the key
    bucket = F.aggregate(F.lit(steps), F.lit(0), lambda at, h: F.when((at + h <= len(cuts)) & (F.get(array, at + h - 1) <= F.col("key")), at + h).otherwise(at))
    rows = rows.withColumn("bucket", bucket)
    first = F.get(array, F.col("bucket") - 1) == F.col("key")
    before = F.struct(F.when(F.col("bucket") > 1, F.col("bucket") - 1).otherwise(len(cuts)).alias("bucket"), F.lit(True).alias("ghost"), (F.col("bucket") == 1).alias("wrapped"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("ghost"), F.lit(False).alias("wrapped"))
    rows = rows.select("doc_id", "text", "key", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    window = W.partitionBy("bucket").orderBy("wrapped", "key", "text", "ghost")
    rows = rows.select("doc_id", "text", "key", "to.bucket", "to.ghost", "to.wrapped")
    return rows.withColumn("next", F.lead("text").over(window)), window


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 200) -> DataFrame:
    """Per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by the start of the next document.  A null text is the empty
    one.  Rows with the same doc_id follow each other by text; a null doc_id comes first; a single row is its own
    next.  Other columns are not looked at.
    """
    rows, window = with_next(documents, doc_id, text, parts)
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("quarter", F.floor(n / 4).cast("int"))
    edited = F.concat(F.col("text").substr(F.lit(1), n - F.col("quarter")), F.coalesce(F.col("next"), F.lit("")).substr(F.lit(1), F.col("quarter")))
    rows = rows.withColumn("edited", edited)
    rows = with_fingerprint(with_fingerprint(rows, "text", "fp"), "edited", "efp")
    rows = rows.select("doc_id", "text", "key", "bucket", "ghost", "wrapped", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       "fp", "fp_set", "efp", "efp_set")
    rows = rows.withColumn("next_set", F.lead("fp_set").over(window)).filter(~F.col("ghost"))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
                       likeness("fp_set", "efp_set").alias("near_edited"), likeness("fp_set", "next_set").alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), parts=RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))


QUERIES = {"op8_fingerprints": op8_fingerprints}
SQL: dict[str, str] = {}
