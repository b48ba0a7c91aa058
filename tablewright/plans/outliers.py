"""Values outside the interquartile fences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.semantics import quoted
from tablewright.plans.selection import quantiles_on_driver
from tablewright.plans.stats import COLUMNS_PER_PASS

# Fewer values than this are not judged; fences lie this many ranges beyond quartiles.
MIN_VALUES, FENCE = 10, 1.5

SCHEMA = (
    "column_name string, n_valid bigint, q1 double, q3 double, lower_bound double, upper_bound double, "
    "minimum double, maximum double, mean double, n_outliers bigint"
)


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fences and outlier counts of the columns that have enough values and some spread.

    Two phases: exact quartiles of all columns, then one scan that counts against the fences.
    """
    rows = []
    for c, (n, (q1, q3)) in quantiles_on_driver(df, list(columns), [0.25, 0.75]).items():
        if n < MIN_VALUES or q1 == q3:
            continue
        low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
        v = quoted(c).cast("double")
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"), F.lit(n).cast("bigint").alias("n_valid"),
                F.lit(q1).alias("q1"), F.lit(q3).alias("q3"),
                F.lit(low).alias("lower_bound"), F.lit(high).alias("upper_bound"),
                F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"),
                F.count_if((v < low) | (v > high)).alias("n_outliers"),
            )
        )
    if not rows:
        return df.sparkSession.createDataFrame([], SCHEMA)
    out: DataFrame | None = None
    for i in range(0, len(rows), COLUMNS_PER_PASS):
        part = df.agg(F.array(*rows[i:i + COLUMNS_PER_PASS]).alias("r")).select(F.inline("r"))
        out = part if out is None else out.unionByName(part)
    return out


