"""Reading the given tables, and views of them with gaps, repeats and loose types.

The views are lists of select items written once and used by both engines.  Gaps come from the data's
own values (a zero discount counts as unknown, and so on) and every row of the table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.files import read_parquet

# lineitem with missing numbers (about 1 in 11, and 1 in 3), text (about 7 in 10) and dates.
GAPPY_LINEITEM = [
    "l_orderkey",
    "l_quantity",
    "l_extendedprice",
    "nullif(l_discount, 0) AS l_discount",
    "CASE WHEN l_tax >= 0.03 THEN l_tax END AS l_tax",
    "CASE WHEN l_quantity > 35 THEN l_returnflag END AS l_returnflag",
    "CASE WHEN l_linestatus = 'O' OR l_quantity > 10 THEN l_shipdate END AS l_shipdate",
]

# A narrow projection of lineitem, where many rows repeat.
REPEATED_LINEITEM = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

# lineitem with text that mixes numbers and words, negative numbers, and case and space variants.
LOOSE_LINEITEM = [
    "l_quantity - 10 AS net_quantity",
    "CASE WHEN l_discount < 0.05 THEN 'none' ELSE CAST(l_linenumber AS STRING) END AS discount_code",
    "CASE WHEN l_linestatus = 'O' THEN lower(l_returnflag) ELSE l_returnflag END AS flag",
    "CASE WHEN l_quantity > 45 THEN ' O' ELSE l_linestatus END AS status",
    "CASE WHEN l_quantity > 20 THEN l_tax END AS tax",
    "1 AS one",
    "CAST(NULL AS DOUBLE) AS nothing",
]

# orders with every column as text.
TEXT_ORDERS = [
    "CAST(o_orderkey AS STRING) AS order_text",
    "CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_text",
    "CASE WHEN o_totalprice > 200000 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS some_dates",
    "o_orderpriority AS priority_text",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, items: list[str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*items)


def sql_view(name: str, items: list[str]) -> str:
    return f"SELECT {', '.join(items)} FROM {name}"


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
