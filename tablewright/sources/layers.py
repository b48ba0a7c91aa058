"""The bronze, silver and gold layers as Parquet."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def store_bronze(df: DataFrame, root: str, dataset: str, load_ts: datetime | None = None) -> str:
    """Store the rows as they came under a load time, and a line in the manifest.  Returns the load.

    A load is its own folder, named to the microsecond, so doing it again after a failure replaces it, and two
    loads of one second both stay.
    """
    at = load_ts or _now()
    load = at.strftime("%Y%m%d_%H%M%S") + (f"_{at.microsecond:06d}" if at.microsecond else "")
    path = f"{root}/bronze/{dataset}"
    df.write.mode("overwrite").parquet(f"{path}/load_ts={load}")
    written = df.sparkSession.read.parquet(f"{path}/load_ts={load}")
    line = written.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset).alias("dataset"), F.lit(load).alias("load_ts"), "row_count",
        F.lit(len(df.columns)).alias("column_count"), F.lit(f"{path}/load_ts={load}").alias("path"),
        F.current_timestamp().alias("written_at"),
    )
    line.coalesce(1).write.mode("append").parquet(f"{root}/manifest/bronze")
    return load


def load_bronze(spark: SparkSession, root: str, dataset: str, load: str | None = None) -> DataFrame:
    """One load, or all loads with their `load_ts` (a partition column, so filters prune)."""
    path = f"{root}/bronze/{dataset}"
    return spark.read.parquet(f"{path}/load_ts={load}" if load else path)


def list_bronze(spark: SparkSession, root: str) -> DataFrame:
    """The manifest, newest load first."""
    lines = spark.read.parquet(f"{root}/manifest/bronze")
    last = F.max_by(F.struct("row_count", "column_count", "path"), F.struct("written_at", "row_count"))  # of a load done again
    lines = lines.groupBy("dataset", "load_ts").agg(last.alias("line")).select("dataset", "load_ts", "line.*")
    return lines.orderBy(F.desc("load_ts"), "dataset")


def store_silver(df: DataFrame, root: str, dataset: str, load: str) -> str:
    """The cleaned rows of a load.  Writing the same load again replaces it."""
    path = f"{root}/silver/{dataset}/load_ts={load}"
    df.write.mode("overwrite").parquet(path)
    return path


def store_gold(tables: dict[str, DataFrame], root: str, dataset: str) -> list[str]:
    """Each named table under the dataset.  Tables are small; each is one file."""
    paths = []
    for name, table in tables.items():
        path = f"{root}/gold/{dataset}/{name}"
        table.coalesce(1).write.mode("overwrite").parquet(path)
        paths.append(path)
    return paths
