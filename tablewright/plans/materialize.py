"""Cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.  Only a session in one process may do without: it takes a temporary one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local($|\[)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tablewright-"))
    return context.getCheckpointDir()


def materialize_rows(df: DataFrame) -> DataFrame:
    """Write the rows of a large table as Parquet in the checkpoint folder and read them back.

    Passes that follow read only the columns they need, which a checkpoint would not allow.
    """
    if any(isinstance(f.dataType, (T.NullType, T.DayTimeIntervalType, T.CalendarIntervalType)) for f in df.schema.fields):
        return materialize(df)  # Parquet has no such types
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write a small intermediate result to the checkpoint folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
