"""Differences between neighbouring sorted integers, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.semantics import quoted
from tablewright.plans.stats import WORD, value_words

# Values are cut into blocks of 2^BLOCK_BITS by their high bits, so a block has at most that many
# distinct values however skewed the data; blocks are cut the same way into super-blocks.
BLOCK_BITS = 20


def _gap(first: Column, before: Column) -> Column:
    """The difference as a double, exact where it is small; it may exceed the integer range."""
    exact = F.try_subtract(first, before).cast("double")
    return F.coalesce(exact, first.cast("double") - before.cast("double"))


def _with_gap(unit: Column, square: Column, mean: float) -> list[Column]:
    """Unit gaps and squared deviations of a level: those of the levels below, and its own."""
    off = F.col("gap") - F.lit(mean)
    return [
        (unit + F.count_if(F.col("gap") == 1)).alias("unit"),
        (square + F.coalesce(F.sum(off * off), F.lit(0.0))).alias("square"),
    ]


def adjacent_gaps(df: DataFrame, column: str) -> DataFrame:
    """One row about the sorted values of an integer column.

    n_values, n_distinct, n_unit (neighbours exactly 1 apart), gap_mean and gap_std (population);
    repeated values count as gaps of 0.  The mean gap follows from count and range, which are read
    first, so that deviations can be summed without cancellation.
    """
    v = quoted(column).cast("bigint")
    ends = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    n = ends["n"]
    mean = (ends["hi"] - ends["lo"]) / (n - 1) if n > 1 else 0.0
    words = value_words(df.filter(v.isNotNull()).select(v.alias("v")))
    bit = lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1).cast("bigint")) == 1
    places = words.withColumn("at", F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), bit))
    off = lambda i: F.element_at("at", i + 1) - F.element_at("at", i) - F.lit(float(mean))
    steps = F.when(F.size("at") > 1, F.sequence(F.lit(1), F.size("at") - 1)).otherwise(F.array().cast("array<int>"))
    value = lambda i: F.col("word") * WORD + F.element_at("at", F.lit(i))
    level = places.select(
        F.col("word").alias("block"), F.size("at").cast("bigint").alias("d"),
        F.bit_count(F.col("bits").bitwiseAND(F.call_function("shiftright", F.col("bits").bitwiseAND(F.lit(~1).cast("bigint")), F.lit(1)).bitwiseAND(F.lit((1 << 63) - 1)))).cast("bigint").alias("unit"),
        F.aggregate(steps, F.lit(0.0), lambda s, i: s + off(i) * off(i)).alias("square"), value(1).alias("first"), value(-1).alias("last"))
    # Words into blocks, then twice by the next BLOCK_BITS; what is left after that are the top 4 bits of a 64-bit number.
    for upper in (F.shiftright("block", BLOCK_BITS - 6), F.shiftright("block", BLOCK_BITS), F.shiftright("block", BLOCK_BITS), F.lit(0)):
        beside = Window.partitionBy("upper").orderBy("block")
        level = (
            level.withColumn("upper", upper)
            .withColumn("gap", _gap(F.col("first"), F.lag("last").over(beside)))
            .groupBy(F.col("upper").alias("block"))
            .agg(
                F.sum("d").alias("d"), *_with_gap(F.sum("unit"), F.sum("square"), mean),
                F.min("first").alias("first"), F.max("last").alias("last"),
            )
        )
    whole = level.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("d", "unit", "square")])
    repeats = (F.lit(n) - F.col("d")) * F.lit(float(mean) ** 2)
    return whole.select(
        F.lit(n).cast("bigint").alias("n_values"),
        F.col("d").alias("n_distinct"),
        F.col("unit").alias("n_unit"),
        F.lit(float(mean) if n > 1 else None).cast("double").alias("gap_mean"),
        F.sqrt(F.try_divide(F.col("square") + repeats, F.lit(float(n - 1)))).alias("gap_std"),
    )
