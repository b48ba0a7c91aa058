"""Delimited files: manifest, encodings, hashes and scans."""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.semantics import columns_of, nan_to_null, quoted
from tablewright.plans.materialize import materialize
from tablewright.sources.lines import byte_facts, csv_records, lines_of, path_of, quote_states

# File types taken, and the size limits of the two loaders.
EXTENSIONS = (".csv", ".xlsx", ".xls")
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
# Files up to this size are one value of a row.
LARGE_FILE = 1 << 30


class DataLoadError(ValueError):
    """A file or dataset that cannot be taken."""


def _files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def _plain_path(c: Column) -> Column:
    """A path spelled as the file source's `path` column spells it."""
    return F.regexp_replace(c, r"^([A-Za-z0-9]+):/+", "$1:/")


def file_manifest(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """path, length, extension, status (ok, unsupported, empty, too_large); contents are not read.

    A scan passes over empty files, so they are taken from the listing that any scan makes.
    """
    scanned = _files(spark, path)
    listed = spark.createDataFrame([(p,) for p in scanned.inputFiles()], "uri string").select(
        _plain_path(F.url_decode(F.regexp_replace("uri", r"\+", "%2B"))).alias("path")
    )
    sizes = scanned.select(_plain_path(F.col("path")).alias("path"), "length")
    files = listed.join(sizes, "path", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    status = (
        F.when(~F.col("extension").isin(*EXTENSIONS), "unsupported")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > max_bytes, "too_large")
        .otherwise("ok")
    )
    return files.select("path", "length", extension.alias("extension")).withColumn("status", status)


def file_hashes(spark: SparkSession, path: str, large: int = LARGE_FILE) -> DataFrame:
    """path, sha256 of the contents, and its first 16 characters.

    Files of more than `large` bytes do not fit one value: their lines are put in order, and stream through one
    task a file, as the digest demands.
    """
    files = _files(spark, path)
    digests = files.filter(F.col("length") <= large).select("path", F.sha2("content", 256).alias("sha256"))
    sizes = files.filter(F.col("length") > large).select("path")
    if not sizes.isEmpty():
        digests = digests.unionByName(_streamed_hashes(spark, [r["path"] for r in sizes.collect()]))
    return digests.select("path", "sha256", F.substring("sha256", 1, 16).alias("short_hash"))


def _streamed_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256 of files of any size, from their lines in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running, left = None, None, 0
        done: list[tuple[str, str]] = []

        def end(last: bytes) -> None:
            running.update(last)
            done.append((current, running.hexdigest()))

        waiting = b""  # the last line ends the file, with a line break or without
        for batch in batches:
            for uri, marked, size, line in zip(*(c.to_pylist() for c in batch.columns)):
                if uri != current:
                    if current is not None:
                        end(waiting[:left])
                    current, running, left, waiting = uri, hashlib.sha256(), size, b""
                    if marked:
                        running.update(b"\xef\xbb\xbf")
                        left -= 3
                running.update(waiting)
                left -= len(waiting)
                waiting = line + b"\n"
        if current is not None:
            end(waiting[:left])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["uri", "sha256"])

    marks = byte_facts(spark, paths).select("uri", "marked")
    lines = lines_of(spark, paths).join(F.broadcast(marks), "uri")
    ordered = lines.repartition("uri").sortWithinPartitions("uri", "block", "at")
    found = ordered.select("uri", "marked", "size", F.col("value").cast("binary")).mapInArrow(digest, "uri string, sha256 string")
    return found.select(path_of(F.col("uri")).alias("path"), "sha256")


def file_encodings(spark: SparkSession, path: str | list[str], parts: bool = False) -> DataFrame:
    """path, encoding: by byte-order mark, else UTF-8 if the whole file is valid, else CP1252 or Latin-1.

    Whole contents are examined, in as many tasks as the files have splits.  Empty files have no row.
    With `parts` a folder's files are parts of one text, as Spark writes them: its path and encoding, by
    a byte-order mark if every part has it.
    """
    facts = byte_facts(spark, path).withColumn("utf16", F.coalesce(F.col("head").isin("FFFE", "FEFF"), F.lit(False)))
    if parts:
        folder = F.regexp_replace("uri", "/[^/]*$", "").alias("uri")
        facts = facts.groupBy(folder).agg(*[every(c).alias(c) for c, every in (
            ("valid", F.bool_and), ("undefined", F.bool_or), ("marked", F.bool_and), ("utf16", F.bool_and))])
    encoding = (
        F.when(F.col("marked"), "utf-8-sig")
        .when(F.col("utf16"), "utf-16")
        .when(F.col("valid"), "utf-8")
        .when(~F.col("undefined"), "cp1252")
        .otherwise("latin-1")
    )
    return facts.select(path_of(F.col("uri")).alias("path"), encoding.alias("encoding"))


# Names Spark's reader knows the encodings by.  It drops a UTF-8 byte-order mark by itself, and has no
# CP1252: such files are read as Latin-1, which differs only in the characters below.
_READER_ENCODING = {
    "utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf-16": "UTF-16", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1",
}
_CP1252_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_AS_LATIN = bytes(_CP1252_BYTES).decode("latin-1")
_AS_CP1252 = bytes(_CP1252_BYTES).decode("cp1252")


def quoted_line_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether any line has an odd number of quotes, as the lines have that a quoted break cuts apart."""
    return not quote_states(spark, path).filter("turns > 0").isEmpty()


def _parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of records, and `__bad`, which holds a record that does not fit the schema."""
    whole = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in whole.fields)
    options = {"escape": '"', "columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}
    return records.filter("NOT header").select("uri", F.from_csv("record", F.lit(ddl), options).alias("__row")).select("uri", "__row.*")


def bad_lines(spark: SparkSession, path: str | list[str], schema: T.StructType, multiline: bool | None = None) -> DataFrame:
    """path, n_rows, n_bad, n_empty: records of each file, those that do not fit the schema (read_csv gives them nulls,
    or skips them), and those without any value."""
    states = None if multiline is False else materialize(quote_states(spark, path))
    if states is not None and (multiline or not states.filter("turns > 0").isEmpty()):
        rows = _parsed(csv_records(spark, path, states=states), schema).withColumnRenamed("uri", "path")
    else:
        whole = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
        rows = (
            spark.read.schema(whole).option("header", "true").option("escape", '"')
            .option("columnNameOfCorruptRecord", "__bad").option("columnPruning", "false").csv(path)
        ).select("*", F.col("_metadata.file_path").alias("path"))
    seen = F.coalesce(*[quoted(f.name).cast("string") for f in schema.fields])
    bad = F.col("__bad").isNotNull()
    return rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"), F.count_if(~bad & seen.isNull()).alias("n_empty"))


def _inferred(records: DataFrame) -> T.StructType:
    """Names from a header, and for each column the first of int, bigint, double, timestamp and boolean that all its values have."""
    header = records.filter("header").select("record").first()
    if header is None:
        return T.StructType([])
    names = next(csv.reader([header["record"]]))
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = _parsed(records, text)
    kinds = ("int", "bigint", "double", "timestamp", "boolean")
    whole = lambda c: F.col(c).rlike(r"^[+-]?\d+$")
    fits = [
        F.bool_and(F.when(F.col(c).isNotNull(), F.col(c).try_cast(k).isNotNull() & (whole(c) if k in ("int", "bigint") else F.lit(True)))).alias(f"{c}_{k}")
        for c in text.names for k in kinds
    ]
    found = rows.agg(*fits).first() if fits else None
    types = [next((k for k in kinds if found[f"{c}_{k}"]), "string") for c in text.names]
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(names, types)])


def read_csv(
    spark: SparkSession, path: str | list[str], *, schema: T.StructType | str | None = None,
    encoding: str = "utf-8", skip_bad_lines: bool = False, multiline: bool | None = None,
) -> DataFrame:
    """Header and comma.  Types are inferred unless a schema is given, which spares a scan.

    Whether there are line breaks inside quotes is found by a scan of the lines unless `multiline` says so.
    Files that have some are read in splits too (see `csv_records`), but for UTF-16.
    """
    charset = _READER_ENCODING.get(encoding, encoding)
    states = None
    if encoding != "utf-16" and multiline is not False:
        states = materialize(quote_states(spark, path))
        if multiline is None:
            multiline = not states.filter("turns > 0").isEmpty()
    if multiline and states is not None:
        records = csv_records(spark, path, charset, states)
        if schema is None:
            schema = _inferred(records)
        elif isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        df = _parsed(records, schema)
        df = (df.filter("__bad IS NULL") if skip_bad_lines else df).drop("uri", "__bad")
    else:
        reader = (
            spark.read.option("header", "true")
            .option("encoding", charset)
            .option("escape", '"')
            .option("mode", "DROPMALFORMED" if skip_bad_lines else "PERMISSIVE")
            .option("multiLine", str(bool(multiline) or encoding == "utf-16").lower())  # lines of UTF-16 cannot be split as bytes
        )
        reader = reader.option("inferSchema", "true") if schema is None else reader.schema(schema)
        df = reader.csv(path)
    if encoding == "cp1252":
        to_cp1252 = str.maketrans(_AS_LATIN, _AS_CP1252)
        df = df.toDF(*[c.translate(to_cp1252) for c in df.columns])
        df = df.withColumns({c: F.translate(quoted(c), _AS_LATIN, _AS_CP1252) for c in columns_of(df, "text")})
    return nan_to_null(df)


def read_csv_any_encoding(spark: SparkSession, path: str, **options) -> DataFrame:
    """All files under a path, each read in its own encoding; one scan per encoding met.

    The list of paths comes to the driver, as it does in any file scan.
    """
    by_encoding: dict[str, list[str]] = {}
    for r in file_encodings(spark, path).collect():
        by_encoding.setdefault(r["encoding"], []).append(r["path"])
    if not by_encoding:
        raise DataLoadError(f"no files under {path}")
    out: DataFrame | None = None
    for encoding in sorted(by_encoding):
        part = read_csv(spark, by_encoding[encoding], encoding=encoding, **options)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def require_rows(df: DataFrame) -> DataFrame:
    """The frame itself, or an error if it has no rows."""
    if df.isEmpty():
        raise DataLoadError("dataset contains no data rows")
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with NaN read as missing."""
    return nan_to_null(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """The dataset as CSV with a header; white space at the ends of values is kept."""
    (df.select(*columns) if columns else df).write.mode("overwrite").options(
        header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(path)
