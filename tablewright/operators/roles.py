"""What each column is for: identifier, measure, dimension, date, flag or free text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.names import looks_like_id
from tablewright.functions.semantics import DAY_FIRST_FORMATS, INTEGRAL, kind_of, parse_timestamp, quoted
from tablewright.plans.gaps import adjacent_gaps
from tablewright.plans.stats import column_stats, distinct_counts, pin, text_columns

# A dimension has this many distinct values.
DIMENSION_MIN, DIMENSION_MAX = 2, 50

ROLE_SCHEMA = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("is_dimension", T.BooleanType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_valid", T.LongType()),
        T.StructField("n_distinct", T.LongType()),
    ]
)


@dataclass
class Roles:
    """Column names by role, in table order."""

    n_rows: int
    rows: list[tuple]
    measures: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    datetimes: list[str] = field(default_factory=list)


def is_identifier(
    df: DataFrame, name: str, integral: bool, n: int, n_distinct: int, minimum: float | None
) -> bool:
    """Whether a numeric column counts or labels rows rather than measures something.

    By name; or almost every value occurs once and the values run without gaps, or are all
    non-negative; or the sorted values are evenly spaced.  Spacing is looked at only when the counts
    leave the question open.
    """
    if looks_like_id(name):
        return True
    if not integral or n == 0:
        return False
    unique, non_negative = n_distinct / n, minimum is not None and minimum >= 0
    if unique > 0.99 and n > 20 and non_negative:
        return True
    consecutive = unique > 0.95 and n > 20
    even = unique > 0.8 and n > 50 and non_negative
    if not (consecutive or even):
        return False
    gaps = adjacent_gaps(df, name).first()
    if consecutive and gaps["n_unit"] / (n - 1) > 0.9:
        return True
    return even and gaps["gap_std"] < 2


def classify(df: DataFrame, columns: Iterable[str] | None = None) -> Roles:
    """Roles of the columns: a statistics scan, a distinct count, and spacing where undecided."""
    names = list(df.columns if columns is None else columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    kinds = {c: kind_of(types[c]) for c in names}
    stats = {r["column_name"]: r for r in column_stats(df, names).collect()}
    counted = [c for c in names if kinds[c] == "text" or isinstance(types[c], INTEGRAL)]
    distinct = (
        {r["column_name"]: r["n_distinct"] for r in distinct_counts(df, counted).collect()}
        if counted
        else {}
    )
    n_rows = stats[names[0]]["n_rows"] if names else 0
    roles = Roles(n_rows=n_rows, rows=[])
    for position, c in enumerate(names):
        kind, n_valid, n_distinct = kinds[c], stats[c]["n_valid"], distinct.get(c)
        is_dimension = kind == "text" and DIMENSION_MIN <= (n_distinct or 0) <= DIMENSION_MAX
        if kind in ("boolean", "datetime"):
            role = kind
        elif kind == "numeric":
            integral = isinstance(types[c], INTEGRAL)
            as_id = is_identifier(df, c, integral, n_valid, n_distinct or 0, stats[c]["minimum"])
            role = "id" if as_id else "measure"
        elif kind == "text":
            many = n_rows > 0 and (n_distinct or 0) / n_rows > 0.5 and (n_distinct or 0) > 50
            role = "high_cardinality" if many else "dimension"
        else:
            role = "other"
        if role == "measure":
            roles.measures.append(c)
        elif role == "id":
            roles.identifiers.append(c)
        elif role == "datetime":
            roles.datetimes.append(c)
        if is_dimension:
            roles.dimensions.append(c)
        roles.rows.append(
            (c, position, types[c].simpleString(), role, is_dimension, n_rows, n_valid, n_distinct)
        )
    return roles


def column_roles(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column with its role."""
    return df.sparkSession.createDataFrame(classify(df, columns).rows, ROLE_SCHEMA)


def dimension_cardinality(df: DataFrame) -> DataFrame:
    """column_name, n_distinct, is_dimension for every text column."""
    n = F.col("n_distinct")
    return distinct_counts(df, text_columns(df)).select(
        "column_name", "n_distinct", n.between(DIMENSION_MIN, DIMENSION_MAX).alias("is_dimension")
    )


def text_profile_types(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Profile type of text columns from mean length and the share of distinct values."""
    names = list(text_columns(df) if columns is None else columns)
    stats = column_stats(df, names, moments=False, text=True)
    both = stats.join(F.broadcast(distinct_counts(df, names)), "column_name", "left")
    n, d = F.col("n_valid"), F.coalesce(F.col("n_distinct"), F.lit(0))
    share = F.try_divide(d.cast("double"), n)
    profile_type = (
        F.when(n == 0, "text")
        .when(F.col("mean_length") > 50, "text")
        .when((d <= 30) | (share < 0.05), "categorical")
        .when(share > 0.5, "identifier")
        .when(share < 0.3, "categorical")
        .otherwise("identifier")
    )
    return both.select(
        "column_name", "n_valid", d.alias("n_distinct"), "mean_length", profile_type.alias("profile_type")
    )


def profile_types(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """column_name, profile_type for every column (numbers that identify are identifiers)."""
    roles = roles or classify(df)
    names = {"id": "identifier", "measure": "numeric", "boolean": "boolean", "datetime": "datetime"}
    fixed = [(c, names.get(role, "text")) for c, _, _, role, *_ in roles.rows if role not in ("dimension", "high_cardinality")]
    out = df.sparkSession.createDataFrame(fixed, "column_name string, profile_type string")
    if text_columns(df):
        out = out.unionByName(text_profile_types(df).select("column_name", "profile_type"))
    return out


def date_like_text(df: DataFrame) -> DataFrame:
    """column_name, n_checked, is_datetime: whether all present values are dates.  One scan for all columns."""
    columns = text_columns(df)
    facts = [
        F.struct(
            F.lit(c).alias("column_name"), F.count(quoted(c)).alias("n_checked"),
            F.coalesce(F.bool_and(parse_timestamp(quoted(c)).isNotNull() | quoted(c).isNull())
                       | F.bool_and(parse_timestamp(quoted(c), DAY_FIRST_FORMATS).isNotNull() | quoted(c).isNull()), F.lit(True)).alias("is_datetime"),
        )
        for c in columns
    ]
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, n_checked bigint, is_datetime boolean")
    return df.agg(F.array(*facts).alias("r")).select(F.inline("r"))


def structure(df: DataFrame) -> DataFrame:
    """One row per column: kind, whether it may be a key, and its cardinality class."""
    plain = [f.name for f in df.schema.fields if kind_of(f.dataType) != "nested"]
    stats = column_stats(df, moments=False)
    both = stats.join(F.broadcast(distinct_counts(df, plain)), "column_name", "left")
    d, is_text = F.col("n_distinct"), F.col("kind") == "text"
    return both.select(
        "column_name",
        "kind",
        "n_rows",
        "n_distinct",
        (F.coalesce(d == F.col("n_rows"), F.lit(False)) | F.lower("column_name").contains("id")).alias("id_candidate"),
        F.when(is_text & (d > 50), "high").when(is_text & (d <= 10), "low").alias("cardinality"),
    )


def id_statistics(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """What the identifier test looks at, per integer column."""
    names = list(columns)
    out = None
    for c in names:
        row = adjacent_gaps(df, c).select(F.lit(c).alias("column_name"), "*")
        out = row if out is None else out.unionByName(row)
    low = column_stats(df, names).select("column_name", "minimum", "maximum")
    return out.join(F.broadcast(pin(low)), "column_name")
