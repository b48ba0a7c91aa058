"""Bringing per-key results back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.semantics import kind_of, quoted
from tablewright.plans.materialize import materialize
from tablewright.plans.stats import short_key

# A per-key table up to this many rows is broadcast.  It holds a key of at most 128 characters and a
# few numbers, so this is some tens of megabytes at most.
BROADCAST_KEYS = 500_000
# A key with more than one row in HOT_SHARE is hot.  There can be no more than HOT_SHARE such keys.
HOT_SHARE = 1_000


def attach_aggregates(rows: DataFrame, key: str, aggregates: dict[str, Column], source: DataFrame | None = None) -> DataFrame:
    """Add to each row aggregates over all rows (of `source`, else of `rows`) that share its key.

    Rows without a key get null.  The per-key table is computed once (rows are combined before the
    shuffle, whatever a key's share) and counted.  A small one is broadcast, so rows do not move.  A
    larger one is joined by shuffle; the rows of hot keys, counted among the rows that are joined, take
    their results from a broadcast instead and stay where they are, as rows without a key do.
    """
    base = rows if source is None else source
    by = short_key(quoted(key)) if kind_of(rows.schema[key].dataType) == "text" else quoted(key)
    per_key = materialize(
        base.filter(quoted(key).isNotNull())
        .groupBy(by.alias("__key"))
        .agg(*[a.alias(f"__{n}") for n, a in aggregates.items()], F.count(F.lit(1)).alias("__rows"))
    )
    size = per_key.agg(F.count(F.lit(1)).alias("keys"), F.sum("__rows").alias("rows")).first()
    names = list(aggregates)
    if size["keys"] <= BROADCAST_KEYS:
        small = per_key.drop("__rows")
        joined = rows.join(F.broadcast(small), by == F.col("__key"), "left")
        return joined.select(*[quoted(c) for c in rows.columns], *[F.col(f"__{n}").alias(n) for n in names])
    counts = per_key.select("__key", "__rows") if source is None else materialize(
        rows.filter(quoted(key).isNotNull()).groupBy(by.alias("__key")).agg(F.count(F.lit(1)).alias("__rows")))
    n = counts.agg(F.sum("__rows")).first()[0] or 0
    frequent = counts.filter(F.col("__rows") * HOT_SHARE > n).select(F.col("__key").alias("__hot"))
    hot = F.broadcast(materialize(frequent))
    results = [quoted(c) for c in rows.columns] + [F.col(f"__{name}").alias(name) for name in names]
    small = per_key.drop("__rows")
    of_hot = F.broadcast(small.join(hot, F.col("__key") == F.col("__hot"), "left_semi"))
    aside = rows.join(hot, by == F.col("__hot"), "left_semi").join(of_hot, by == F.col("__key"), "left").select(results)
    bare = rows.filter(quoted(key).isNull()).withColumns({f"__{name}": F.lit(None).cast(per_key.schema[f"__{name}"].dataType) for name in names}).select(results)
    cold = rows.filter(quoted(key).isNotNull()).join(hot, by == F.col("__hot"), "left_anti")
    return cold.join(small, by == F.col("__key"), "left").select(results).union(aside).union(bare)
