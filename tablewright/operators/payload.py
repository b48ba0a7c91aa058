"""JSON kept as text in a column: which paths and types it has, columns from its fields, groups by a field.

Texts are parsed once a row into variants, on the JVM.  What is no JSON is counted, never dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.semantics import quoted, total
from tablewright.plans.materialize import materialize

#: Fields that `payload_columns` makes columns of at most; keys beyond that are data, not a schema.
MOST_FIELDS = 1000

PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_]*$"


def state_of(text: Column, value: Column) -> Column:
    """missing (null), broken (no JSON) or whole, for a text and its variant."""
    return F.when(text.isNull(), "missing").when(value.isNull(), "broken").otherwise("whole")


def kind_of_value(value: Column) -> Column:
    """object, array, string, whole, number, boolean or null; the type's own name for anything else."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null")
        .when(kind == "BIGINT", "whole").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .otherwise(F.lower(kind))
    )


def _step(path: Column, key: Column) -> Column:
    """The path of a child: of an element of an array, or of a field by its name."""
    return F.when(key.isNull(), F.concat(path, F.lit("[]"))).when(key.rlike(PLAIN_KEY), F.concat(path, F.lit("."), key)).otherwise(
        F.concat(path, F.lit("['"), key, F.lit("']")))


def payload_paths(df: DataFrame, column: str) -> DataFrame:
    """path, kind, n: how often each path holds a value of each kind, over all rows.

    `$` is the whole text, which may also be broken or missing; `[]` stands for the elements of an array.  The
    schema is merged over all rows: a path with several kinds has several rows.  One scan a level of nesting,
    each with combinable counts; an empty table gives no rows.
    """
    text = quoted(column)
    level = df.select(text.alias("text"), F.try_parse_json(text).alias("v")).select(
        F.lit("$").alias("path"), "v", F.when(state_of(F.col("text"), F.col("v")) == "whole", kind_of_value(F.col("v"))).otherwise(
            state_of(F.col("text"), F.col("v"))).alias("kind"))
    out: DataFrame | None = None
    while True:
        counts = materialize(level.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")))
        out = counts if out is None else out.unionByName(counts)
        if counts.filter(F.col("kind").isin("object", "array")).isEmpty():
            return out
        inside = level.filter(F.col("kind").isin("object", "array")).select("path", "v")
        children = inside.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        level = children.select(_step(F.col("path"), F.col("key")).alias("path"), F.col("value").alias("v"), kind_of_value(F.col("value")).alias("kind"))


def payload_fields(df: DataFrame, column: str) -> list[tuple[str, str]]:
    """Fields of the objects in a column with the type that holds all their values, by name.

    Whole numbers are bigint, with others double; fields of several kinds, objects and arrays stay text.
    """
    text = quoted(column)
    objects = df.select(F.try_parse_json(text).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    fields = objects.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).groupBy("key").agg(
        F.collect_set(kind_of_value(F.col("value"))).alias("kinds"))  # a set of some ten words
    rows = fields.limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"{column} has more than {MOST_FIELDS} different keys; count them with payload_paths")

    def merged(kinds: Sequence[str]) -> str:
        kinds = set(kinds) - {"null"}
        if kinds <= {"whole"} and kinds:
            return "bigint"
        if kinds <= {"whole", "number"} and kinds:
            return "double"
        return "boolean" if kinds == {"boolean"} else "string"

    return sorted((r["key"], merged(r["kinds"])) for r in rows)


def field_of(value: Column, key: str, data_type: str) -> Column:
    """A field of a variant as a column; null where it is absent or does not fit."""
    if "'" in key and '"' in key:  # no path can spell it
        return F.try_variant_get(F.element_at(value.try_cast("map<string,variant>"), key), "$", data_type)
    quote = '"' if "'" in key else "'"
    return F.try_variant_get(value, f"$[{quote}{key}{quote}]", data_type)


def payload_columns(df: DataFrame, column: str) -> DataFrame:
    """The frame with a column `<column>_<key>` for each field of its JSON objects, and `<column>_state`.

    A name that is taken gets underscores.  Rows whose text is broken, missing or no object keep null fields.
    """
    names, added = set(df.columns), {}
    value = F.try_parse_json(quoted(column))

    def free(name: str) -> str:
        while name in names:
            name += "_"
        names.add(name)
        return name

    added[free(f"{column}_state")] = state_of(quoted(column), F.col("__payload"))
    for key, data_type in payload_fields(df, column):
        added[free(f"{column}_{key}")] = field_of(F.col("__payload"), key, data_type)
    return df.withColumn("__payload", value).withColumns(added).drop("__payload")


def group_by_payload(df: DataFrame, column: str, path: str, measure: str | None = None) -> DataFrame:
    """state, key, n and, with a measure, its sum: rows grouped by the value at a path, as text.

    Broken and missing texts are groups of their own, with a null key, as are those without the path.
    """
    rows = df.withColumn("__payload", F.try_parse_json(quoted(column)))
    key = F.try_variant_get(F.col("__payload"), path, "string")
    sums = [] if measure is None else [total(quoted(measure).cast("double")).alias(f"{measure}_sum")]
    return rows.groupBy(state_of(quoted(column), F.col("__payload")).alias("state"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"), *sums)
