"""Appends that can be repeated: rows by load and attempt, and a list of the attempts that count.

An attempt's rows are written first and its line in the list last.  A reader takes, for each load, the attempt
that was listed first, so what a failed, repeated or simultaneous attempt leaves behind is never read twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the two columns that a log's rows are partitioned by, and what keeps their values texts.
LOAD, ATTEMPT, MARK = "__load", "__attempt", "k-"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """load, attempt, n_rows, committed_at: the attempt that counts of each load."""
    try:
        lines = spark.read.parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "load string, attempt string, n_rows bigint, committed_at timestamp")
    first = F.min_by(F.struct("attempt", "n_rows", "committed_at"), F.struct("committed_at", "attempt"))
    return lines.groupBy("load").agg(first.alias("line")).select("load", "line.*")


def write_attempt(rows: DataFrame, path: str, load: str, partition_by: Sequence[str] = ()) -> str:
    """Write the rows of a load without listing them.  Returns the attempt."""
    attempt = uuid.uuid4().hex
    keyed = rows.withColumns({LOAD: F.lit(MARK + load), ATTEMPT: F.lit(MARK + attempt)})
    keyed.write.mode("append").partitionBy(LOAD, ATTEMPT, *partition_by).parquet(f"{path}/rows")
    return attempt


def commit(spark: SparkSession, path: str, load: str, attempt: str, n_rows: int) -> None:
    line = spark.createDataFrame([(load, attempt, n_rows)], "load string, attempt string, n_rows bigint")
    line.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def append_load(rows: DataFrame, path: str, load: str, partition_by: Sequence[str] = ()) -> bool:
    """Append the rows under a load key.  False, and nothing is written, if that load is there already."""
    spark = rows.sparkSession
    if not committed(spark, path).filter(F.col("load") == load).isEmpty():
        return False
    attempt = write_attempt(rows, path, load, partition_by)
    mine = (F.col(LOAD) == MARK + load) & (F.col(ATTEMPT) == MARK + attempt)
    written = 0 if rows.isEmpty() else spark.read.parquet(f"{path}/rows").filter(mine).count()
    commit(spark, path, load, attempt, written)
    return True


def read_loads(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all loads, each once, with their `load`; an error if nothing was ever appended."""
    counted = committed(spark, path).select(F.concat(F.lit(MARK), "load").alias(LOAD), F.concat(F.lit(MARK), "attempt").alias(ATTEMPT), "load")
    return spark.read.parquet(f"{path}/rows").join(counted, [LOAD, ATTEMPT]).drop(LOAD, ATTEMPT)
