"""Helpers shared by the corpus operators: tables, folds, bounded samples, batches, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of rows that Spark hands to a Python worker at once, where the session leaves it open.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, so that very long texts do not pile up in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).lower().rstrip("b")
    if not size.isdigit() or int(size) > limit:  # else the session asks for less itself
        spark.conf.set(key, str(limit))


def give_back() -> None:
    """Return memory that this process no longer needs to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], *shared: Broadcast) -> Callable[[Iterator], Iterator]:
    """`run` over the batches of a task, with freed memory given back at its end: workers outlive tasks and stages.

    What a worker has loaded of the `shared` broadcasts goes too; the next task in it loads them again.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for value in shared:
                vars(value).pop("_value", None)
            give_back()

    return wrapped


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text, divisible by `folds`."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only a session in one process may do without: it takes a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="corpus-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write rows as Parquet in the shared folder and read them back: lineage ends there, columns stay prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(labelled: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """About `per_label` rows of each label, or all where there are fewer.

    A row is taken when the hash of its key falls under per_label / count: the same rows whatever the
    partitions are, and no shuffle but that of the counts.  Rows without a label are left out.
    """
    labelled = labelled.filter(F.col(label).isNotNull())
    counts = labelled.groupBy(label).count().collect()
    if not counts:
        return labelled.limit(0)
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col(label) == F.lit(row[0]), F.lit(per_label / row[1])).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.filter(place < share)


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """Texts and labels of a bounded sample of the rows that may be learnt from: (doc_id, text, label).

    Of the labels of one doc_id the largest counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    wanted = bounded_sample(known, "doc_id", "label", per_label)
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(wanted), "doc_id")


def slices(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose lengths add up to `limit` at most; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total + n > limit and i > start:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def utf8(texts) -> list[bytes]:
    """Texts of a batch as bytes; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
