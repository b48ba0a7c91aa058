"""Scans, sinks and ingestion facts, on files that Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.operators import clean as C
from tablewright.operators import profile as P
from tablewright.plans.materialize import ensure_checkpoint_dir
from tablewright.sources import files, layers
from workload.common import TEXT_ORDERS, rounded, sql_view, table, view


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def csv_scan(spark, d):
    path, orders = _scratch(spark, "csv"), table(spark, d, "orders")
    files.write_csv(orders, path)
    return files.read_csv(spark, path, schema=orders.schema)


def csv_documents(spark, d):
    """Texts with line breaks, written and read again."""
    path, docs = _scratch(spark, "csv"), table(spark, d, "documents")
    files.write_csv(docs, path)
    return files.read_csv(spark, path, schema=docs.schema)


def csv_bad_lines(spark, d):
    """Records whose whole number is a word."""
    path, orders = _scratch(spark, "csv"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    files.write_csv(orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.col("o_custkey").cast("string"))), path)
    return files.bad_lines(spark, path, orders.schema).agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_bad", "n_empty")])


def csv_any_encoding(spark, d):
    path, docs = _scratch(spark, "csv"), table(spark, d, "supplier")
    files.write_csv(docs, path)
    return files.read_csv_any_encoding(spark, path, schema=docs.schema)


def file_encodings(spark, d):
    """Texts of each language in files of their own, those of two languages as Latin-1; each task writes its part of each."""
    path = _scratch(spark, "texts")
    docs = table(spark, d, "documents").select("lang", F.regexp_replace("text", "[^\\x{00}-\\x{7F}\\x{A0}-\\x{FF}]", "").alias("text"))
    for charset, own in (("ISO-8859-1", docs.filter("lang IN ('de', 'fr')")), ("UTF-8", docs.filter("lang NOT IN ('de', 'fr')"))):
        own.write.partitionBy("lang").mode("append").option("encoding", charset).csv(path)
    found = files.file_encodings(spark, path, parts=True)
    return found.select(F.regexp_extract("path", "lang=([^/]+)$", 1).alias("lang"), "encoding")


def file_manifest(spark, d):
    """Keys of each status in files of their own; each task writes its part of each, and the parts of a status count once."""
    path = _scratch(spark, "csv")
    keys = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    keys.write.partitionBy("o_orderstatus").csv(path)
    return files.file_manifest(spark, path).groupBy("extension", "status").agg(
        F.count_distinct(F.regexp_extract("path", "(.*)/", 1)).alias("n_files"), F.sum("length").alias("bytes")
    )


def _names_file(spark, d):
    path = _scratch(spark, "text")
    table(spark, d, "customer").orderBy("c_custkey").select("c_name").coalesce(1).write.text(path)
    return path


def file_hashes(spark, d):
    return files.file_hashes(spark, _names_file(spark, d)).drop("path")


def file_hashes_streamed(spark, d):
    """As for files beyond one value: lines in order, streamed."""
    return files.file_hashes(spark, _names_file(spark, d), large=0).drop("path")


def empty_refused(spark, d):
    """Whether a table without rows is refused, and one with rows taken, for each kind of event."""
    events = table(spark, d, "events")
    rows = []
    for kind in ("click", "view", "none of these"):
        try:
            files.require_rows(events.filter(F.col("event_type") == kind))
            rows.append((kind, "taken"))
        except files.DataLoadError:
            rows.append((kind, "refused"))
    return spark.createDataFrame(rows, "event_type string, outcome string")


def bronze_roundtrip(spark, d):
    root = _scratch(spark, "lake")
    load = layers.store_bronze(table(spark, d, "orders"), root, "orders")
    return layers.load_bronze(spark, root, "orders", load)


def bronze_list(spark, d):
    root = _scratch(spark, "lake")
    for name in ("orders", "customer"):
        layers.store_bronze(table(spark, d, name), root, name)
    return layers.list_bronze(spark, root).select("dataset", "row_count", "column_count")


def silver_roundtrip(spark, d):
    root = _scratch(spark, "lake")
    path = layers.store_silver(table(spark, d, "customer"), root, "customer", "first")
    return spark.read.parquet(path)


def gold_roundtrip(spark, d):
    root = _scratch(spark, "lake")
    tables = {"by_status": A.top_groups(table(spark, d, "orders"), "o_orderstatus", "o_totalprice")}
    return rounded(spark.read.parquet(layers.store_gold(tables, root, "orders")[0]), 2, "o_totalprice_sum")


def ingest_metadata(spark, d):
    return P.ingest_metadata(table(spark, d, "customer"), "customer").drop("size_mb")


def auto_date_ratio(spark, d):
    return rounded(C.date_shares(view(spark, d, "orders", TEXT_ORDERS)), 6, "share")


def auto_dates(spark, d):
    return C.parse_dates(view(spark, d, "orders", TEXT_ORDERS))[0].withColumn(
        "date_text", F.col("date_text").cast("date")
    )


QUERIES = {
    "csv_scan": csv_scan,
    "csv_documents": csv_documents,
    "csv_bad_lines": csv_bad_lines,
    "csv_any_encoding": csv_any_encoding,
    "file_encodings": file_encodings,
    "file_manifest": file_manifest,
    "file_hashes": file_hashes,
    "file_hashes_streamed": file_hashes_streamed,
    "empty_refused": empty_refused,
    "bronze_roundtrip": bronze_roundtrip,
    "bronze_list": bronze_list,
    "silver_roundtrip": silver_roundtrip,
    "gold_roundtrip": gold_roundtrip,
    "ingest_metadata": ingest_metadata,
    "auto_date_ratio": auto_date_ratio,
    "auto_dates": auto_dates,
}

_HASHES = "SELECT h AS sha256, h[1:16] AS short_hash FROM (SELECT sha256(string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS h FROM customer)"

SQL = {
    "file_encodings": """
SELECT lang, CASE WHEN lang IN ('de', 'fr') AND bool_or(regexp_matches(text, '[\u00A0-\u00FF]')) THEN 'cp1252' ELSE 'utf-8' END AS encoding
FROM documents WHERE lang IS NOT NULL GROUP BY lang""",
    "file_manifest": "SELECT '.csv' AS extension, 'ok' AS status, count(DISTINCT o_orderstatus) AS n_files, sum(length(o_orderkey::VARCHAR) + 1)::BIGINT AS bytes FROM orders",
    "file_hashes": _HASHES,
    "file_hashes_streamed": _HASHES,
    "empty_refused": "SELECT t AS event_type, CASE WHEN EXISTS (SELECT 1 FROM events WHERE event_type = t) THEN 'taken' ELSE 'refused' END AS outcome "
                     "FROM (VALUES ('click'), ('view'), ('none of these')) AS v(t)",
    "csv_scan": "SELECT * FROM orders",
    "csv_documents": "SELECT * FROM documents",
    "csv_bad_lines": "SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey % 7 = 0) AS n_bad, CAST(0 AS BIGINT) AS n_empty FROM orders",
    "csv_any_encoding": "SELECT * FROM supplier",
    "bronze_roundtrip": "SELECT * FROM orders",
    "silver_roundtrip": "SELECT * FROM customer",
    "gold_roundtrip": "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders GROUP BY 1",
    "bronze_list": "SELECT 'orders' AS dataset, count(*) AS row_count, 6 AS column_count FROM orders "
                   "UNION ALL SELECT 'customer', count(*), 5 FROM customer",
    "ingest_metadata": "SELECT 'customer' AS dataset_name, count(*) AS row_count, 5 AS column_count, "
                       "'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, "
                       "'c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string' AS data_types "
                       "FROM customer",
    "auto_date_ratio": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(CASE WHEN try_strptime({c}, '%Y-%m-%d') IS NULL THEN 0.0 ELSE 1.0 END), 6) "
        f"AS share FROM ({sql_view('orders', TEXT_ORDERS)})"
        for c in ("order_text", "date_text", "some_dates", "priority_text")
    ),
    "auto_dates": f"""
WITH t AS ({sql_view('orders', TEXT_ORDERS)}),
 s AS (SELECT avg(CASE WHEN some_dates IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM t)
SELECT order_text, CAST(date_text AS DATE) AS date_text,
       CASE WHEN share > 0.5 THEN CAST(some_dates AS TIMESTAMP) END AS some_dates, priority_text FROM t, s""",
}
