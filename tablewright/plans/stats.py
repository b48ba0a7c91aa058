"""One scan for every per-column statistic, and one shuffle for every value frequency."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.semantics import (
    DAY_FIRST_FORMATS,
    FLOATING,
    INTEGRAL,
    adjusted_skewness,
    columns_of,
    kind_of,
    parse_number,
    parse_timestamp,
    quoted,
)
from tablewright.plans.materialize import materialize

# Text longer than this is compared by its first characters and the SHA-256 digest of the whole, so
# that no shuffle carries whole texts.  Such a key is longer than any text that stands for itself.
DIGEST_ABOVE = 64
# Columns per aggregate: many more, and the generated code outgrows what the JVM compiles.  Each
# aggregate reads only its own columns, so splitting does not add to what is read.
COLUMNS_PER_PASS = 8
# Neighbouring whole numbers that are kept as the bits of one number.
WORD = 64
# Candidate hashes of repeated rows up to this many (8 bytes each) are broadcast.
BROADCAST_HASHES = 500_000


def column_stats(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    *,
    moments: bool = True,
    text: bool = False,
    dates: bool = False,
) -> DataFrame:
    """One row per column from a single aggregate: counts and, on request, more.

    Columns: column_name, position, data_type, kind, n_rows, n_valid, n_missing; for numerics total,
    mean, std, minimum, maximum and n_negative (`moments`); for text mean_length and n_numeric_text
    (`text`), n_date_text and n_day_first (`dates`: with the month first in dates with slashes, and the day).
    NaN is missing.  Totals and extremes are doubles; `whole_numbers` has those of whole numbers exactly.
    """
    names = list(df.columns if columns is None else columns)
    fields = {f.name: f for f in df.schema.fields}
    no_double, no_count = F.lit(None).cast("double"), F.lit(None).cast("bigint")

    def row(name: str) -> Column:
        field, c = fields[name], quoted(name)
        kind = kind_of(field.dataType)
        if isinstance(field.dataType, FLOATING):
            c = F.when(~F.isnan(c), c)
        x = c.cast("double") if kind == "numeric" else None
        present = F.count(c)
        parts = [
            F.lit(name).alias("column_name"),
            F.lit(df.columns.index(name)).alias("position"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.lit(kind).alias("kind"),
            F.count(F.lit(1)).alias("n_rows"),
            present.alias("n_valid"),
            (F.count(F.lit(1)) - present).alias("n_missing"),
        ]
        if moments:
            parts += [
                (F.sum(x) if x is not None else no_double).alias("total"),
                (F.avg(x) if x is not None else no_double).alias("mean"),
                (F.stddev_samp(x) if x is not None else no_double).alias("std"),
                (F.min(x) if x is not None else no_double).alias("minimum"),
                (F.max(x) if x is not None else no_double).alias("maximum"),
                (F.count_if(x < 0) if x is not None else no_count).alias("n_negative"),
            ]
        if text:
            is_text = kind == "text"
            parts += [
                (F.avg(F.length(c)) if is_text else no_double).alias("mean_length"),
                (F.count(parse_number(c)) if is_text else no_count).alias("n_numeric_text"),
            ]
        if dates:
            parts += [
                (F.count(parse_timestamp(c)) if kind == "text" else no_count).alias("n_date_text"),
                (F.count(parse_timestamp(c, DAY_FIRST_FORMATS)) if kind == "text" else no_count).alias("n_day_first"),
            ]
        return F.struct(*parts)

    out: DataFrame | None = None
    for i in range(0, len(names), COLUMNS_PER_PASS):
        chunk = [row(c) for c in names[i:i + COLUMNS_PER_PASS]]
        part = df.agg(F.array(*chunk).alias("s")).select(F.inline("s"))
        out = part if out is None else out.unionByName(part)
    return out


def whole_numbers(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column_name, n_valid, total, minimum, maximum of whole-number columns, exact at any size (total as a decimal)."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL)]
    names = [c for c in (df.columns if columns is None else columns) if c in whole]
    out = df.sparkSession.createDataFrame([], "column_name string, n_valid bigint, total decimal(38,0), minimum bigint, maximum bigint")
    for i in range(0, len(names), COLUMNS_PER_PASS):
        facts = [
            F.struct(F.lit(c).alias("column_name"), F.count(quoted(c)).alias("n_valid"), F.sum(quoted(c).cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"),
                     F.min(quoted(c)).cast("bigint").alias("minimum"), F.max(quoted(c)).cast("bigint").alias("maximum"))
            for c in names[i:i + COLUMNS_PER_PASS]
        ]
        out = out.unionByName(df.agg(F.array(*facts).alias("s")).select(F.inline("s")))
    return out


def skewness(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """column_name, n_valid, mean, std, skewness (bias-adjusted) of numeric columns.

    Long form, one group per column: the third moment of many columns side by side would outgrow
    generated code.
    """
    names = list(columns)
    wide = df.select(*[quoted(c).cast("double").alias(c) for c in names])
    return (
        wide.unpivot([], [quoted(c) for c in names], "column_name", "v")
        .groupBy("column_name")
        .agg(
            F.count("v").alias("n_valid"),
            F.avg("v").alias("mean"),
            F.stddev_samp("v").alias("std"),
            adjusted_skewness(F.col("v")).alias("skewness"),
        )
    )


def short_key(c: Column) -> Column:
    """Text itself when short, otherwise its beginning and the digest of the whole."""
    return F.when(F.length(c) > DIGEST_ABOVE, F.concat(F.left(c, F.lit(DIGEST_ABOVE)), F.sha2(c, 256))).otherwise(c)


def comparable(name: str, data_type: T.DataType) -> Column:
    """A column as text of bounded length such that equal text means equal value."""
    c, kind = quoted(name), kind_of(data_type)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
    if kind == "nested":
        return short_key(F.to_json(c))
    return short_key(c) if kind == "text" else c.cast("string")


def frequencies(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """column_name, key, n for every value (null included) of every column, in one shuffle.

    The key is the value as text, shortened by `short_key` where it is long.
    """
    names = list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = df.select(*[comparable(c, types[c]).alias(c) for c in names])
    long = texts.unpivot([], [quoted(c) for c in names], "column_name", "key")
    return long.groupBy("column_name", "key").agg(F.count(F.lit(1)).alias("n"))


def value_words(values: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """keys..., word, bits: the distinct values of the bigint column v, as sets of WORD neighbours.

    Value word * WORD + i is there if bit i is; bits is 0 where all values are null.
    """
    v = F.col("v")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), v.bitwiseAND(F.lit(WORD - 1).cast("bigint")).cast("int"))
    word = F.call_function("shiftright", v, F.lit(WORD.bit_length() - 1))
    return values.groupBy(*keys, word.alias("word")).agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint")).alias("bits"))


def distinct_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """column_name, n_distinct (nulls not counted).

    Columns are counted together with those of like type, so that numbers stay numbers; each pass
    reads only its own columns.  Whole numbers are shuffled as sets of WORD neighbours, a bit each, which
    tasks build first: at most a row a value, and for keys without gaps a row for every WORD of them.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    alike: dict[str, list[tuple[str, Column]]] = {}
    for name in columns:
        t, c = types[name], quoted(name)
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            alike.setdefault("whole", []).append((name, c.cast("bigint")))
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            alike.setdefault("real", []).append((name, c.cast("double")))
        else:
            alike.setdefault("text", []).append((name, comparable(name, t)))
    out: DataFrame | None = None
    for kind, members in alike.items():
        values = df.select(*[c.alias(name) for name, c in members])
        long = values.unpivot([], [quoted(name) for name, _ in members], "column_name", "v")
        if kind == "whole":
            part = value_words(long, ["column_name"]).groupBy("column_name").agg(F.sum(F.bit_count("bits")).alias("n_distinct"))
        else:
            part = long.distinct().groupBy("column_name").agg(F.count("v").alias("n_distinct"))
        out = part if out is None else out.unionByName(part)
    return out


def top_values(df: DataFrame, columns: Iterable[str], k: int) -> DataFrame:
    """column_name, value, n, place: the k most frequent values of each column, ties by value.

    Spark keeps only k rows per column and task before the shuffle of the ranking.  Long texts are
    counted by their short keys; those that make the list are then looked up in full.
    """
    names = list(columns)
    by_count = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("key"))
    freq = frequencies(df, names).filter(F.col("key").isNotNull())
    top = freq.withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= k)
    types = {f.name: f.dataType for f in df.schema.fields}
    wordy = [c for c in names if kind_of(types[c]) in ("text", "nested")]
    if not wordy:
        return top.withColumnRenamed("key", "value")
    top = pin(top)
    cut = top.filter(F.length("key") > DIGEST_ABOVE).select("column_name", "key")
    if not cut.isEmpty():
        whole = df.select(*[
            (quoted(c) if kind_of(types[c]) == "text" else F.to_json(quoted(c))).cast("string").alias(c) for c in wordy
        ]).unpivot([], [quoted(c) for c in wordy], "column_name", "value")
        texts = (
            whole.filter(F.length("value") > DIGEST_ABOVE)
            .withColumn("key", short_key(F.col("value")))
            .join(F.broadcast(cut), ["column_name", "key"])
            .groupBy("column_name", "key")
            .agg(F.any_value("value").alias("value"))
        )
        top = top.join(texts, ["column_name", "key"], "left")
        value = F.coalesce("value", "key")
    else:
        value = F.col("key")
    return top.select("column_name", value.alias("value"), "n", "place")


def _row_keys(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns in a form that can be grouped, long text shortened."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def key(name: str) -> Column:
        if kind_of(types[name]) == "text":
            return short_key(quoted(name)).alias(name)
        if isinstance(types[name], T.MapType):
            return F.array_sort(F.map_entries(quoted(name))).alias(name)
        return quoted(name)

    return df.select(*[key(c) for c in names])


@dataclass
class Repeats:
    """Hashes of rows that may repeat: none, a frame small enough to broadcast, or too many (None)."""

    hashed: Column
    hashes: DataFrame | None
    n_hashes: int


def find_repeats(df: DataFrame, columns: Iterable[str] | None = None) -> Repeats:
    """Count rows by a 64-bit hash, which is all that is shuffled; a hash met once is a unique row's."""
    names = list(df.columns if columns is None else columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    values = [
        F.array_sort(F.map_entries(quoted(c))) if isinstance(types[c], T.MapType) else quoted(c) for c in names
    ]
    # The hash passes over nulls, so where they are is hashed too.
    hashed = F.xxhash64(*values, *[quoted(c).isNull() for c in names])
    by_hash = df.groupBy(hashed.alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    repeated = materialize(by_hash.filter(F.col("__n") > 1).select("__h").limit(BROADCAST_HASHES + 1))
    n = repeated.count()
    return Repeats(hashed, repeated if n <= BROADCAST_HASHES else None, n)


def duplicate_counts(
    df: DataFrame, columns: Iterable[str] | None = None, repeats: Repeats | None = None
) -> DataFrame:
    """One row: n_rows and n_duplicates (rows beyond the first of each group of equal rows).

    Exact in two steps: only rows whose hash repeats are grouped by their columns — none in a clean
    table, all if there are too many such hashes to broadcast.  Copies of a row are combined in the
    task that reads them.
    """
    names = list(df.columns if columns is None else columns)
    repeats = repeats or find_repeats(df, names)
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(1).alias("one"))
    if repeats.n_hashes == 0:
        return rows.select("n_rows", F.lit(0).cast("bigint").alias("n_duplicates"))
    suspects = df
    if repeats.hashes is not None:
        suspects = df.withColumn("__h", repeats.hashed).join(F.broadcast(repeats.hashes), "__h", "left_semi")
    groups = _row_keys(suspects, names).groupBy(*[quoted(c) for c in names]).agg(F.count(F.lit(1)).alias("__n"))
    extra = groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"), F.lit(1).alias("one"))
    return rows.join(extra, "one").select("n_rows", "n_duplicates")


def _distinct(df: DataFrame) -> DataFrame:
    """dropDuplicates, by sorted entries for maps, which Spark does not compare."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates()
    keyed = df.withColumns({f"__map_{c}": F.array_sort(F.map_entries(quoted(c))) for c in maps})
    others = [c for c in df.columns if c not in maps]
    return keyed.dropDuplicates([*others, *[f"__map_{c}" for c in maps]]).select(*[quoted(c) for c in df.columns])


def without_duplicates(df: DataFrame, repeats: Repeats | None = None) -> DataFrame:
    """Each distinct row once.  Rows with a hash of their own stay where they are."""
    repeats = repeats or find_repeats(df)
    if repeats.n_hashes == 0:
        return df
    if repeats.hashes is None:
        return _distinct(df)
    names, marked = [quoted(c) for c in df.columns], df.withColumn("__h", repeats.hashed)
    hashes = F.broadcast(repeats.hashes)
    alone = marked.join(hashes, "__h", "left_anti").select(*names)
    return alone.unionByName(_distinct(marked.join(hashes, "__h", "left_semi").select(*names)))


def text_variants(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """column_name, n_distinct, n_normalised: distinct texts before and after lower case and trim."""
    names = list(columns)
    long = df.select(*[quoted(c).cast("string").alias(c) for c in names]).unpivot(
        [], [quoted(c) for c in names], "column_name", "value"
    )
    plain = F.regexp_replace(F.lower("value"), r"^\s+|\s+$", "")
    # Short texts are made distinct as they are and digested after; long ones travel as digests only.
    digests = ["column_name", F.sha2("value", 256).alias("k"), F.sha2(plain, 256).alias("m")]
    short = long.filter(F.length("value") <= DIGEST_ABOVE).distinct().select(*digests)
    wordy = long.filter(F.length("value") > DIGEST_ABOVE).select(*digests).distinct()
    values = short.unionByName(wordy)
    forms = values.groupBy("column_name", "m").agg(F.count(F.lit(1)).alias("k"))
    return forms.groupBy("column_name").agg(
        F.sum("k").alias("n_distinct"), F.count(F.lit(1)).alias("n_normalised")
    )


def pin(df: DataFrame) -> DataFrame:
    """Compute a frame of a few rows (one per column, or a top-k) once, for use by several reports."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def with_positions(rows: DataFrame, df: DataFrame, name: str = "column_name") -> DataFrame:
    """Add the table position of the column named in each row."""
    order = F.array(*[F.lit(c) for c in df.columns])
    return rows.withColumn("position", (F.array_position(order, F.col(name)) - 1).cast("int"))


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "numeric")


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "text")


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "datetime")
