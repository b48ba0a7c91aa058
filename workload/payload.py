"""JSON in the events' details: paths, columns and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import payload as P
from workload.common import rounded, sql_view, table, view

# Events whose details are objects of several shapes, arrays, cut off, or missing.
MIXED_EVENTS = [
    "event_id", "event_type", "value",
    """CASE WHEN event_id % 50 = 0 THEN substr(props, 1, 4) WHEN event_id % 31 = 0 THEN NULL
     WHEN event_id % 7 = 0 THEN concat('{"k": "', event_type, '", "tags": [1, "a", null, {"deep": 1.5}], "at": {"ok": true, "user": ', CAST(user_id AS STRING), '}}')
     WHEN event_id % 11 = 0 THEN concat('[', CAST(user_id AS STRING), ', 2.5]') ELSE props END AS details""",
]
_T = f"({sql_view('events', MIXED_EVENTS)})"


def payload_paths(spark, d):
    return P.payload_paths(view(spark, d, "events", MIXED_EVENTS), "details")


def payload_groups(spark, d):
    return rounded(P.group_by_payload(table(spark, d, "events"), "props", "$.k", "value"), 2, "value_sum")


def payload_broken(spark, d):
    return rounded(P.group_by_payload(view(spark, d, "events", MIXED_EVENTS), "details", "$.at.user", "value"), 2, "value_sum")


def payload_columns(spark, d):
    return P.payload_columns(view(spark, d, "events", MIXED_EVENTS), "details").drop("details", "value")


def payload_types(spark, d):
    whole = P.payload_columns(table(spark, d, "events"), "props")
    return whole.groupBy("event_type").agg(F.sum("props_k").alias("k_sum"), F.count_if(F.col("props_state") == "whole").alias("n"))


QUERIES = {
    "payload_paths": payload_paths,
    "payload_groups": payload_groups,
    "payload_broken": payload_broken,
    "payload_columns": payload_columns,
    "payload_types": payload_types,
}

_STATE = "CASE WHEN details IS NULL THEN 'missing' WHEN json_valid(details) THEN 'whole' ELSE 'broken' END"
_GOOD = "CASE WHEN json_valid(details) THEN details::JSON END"
SQL = {
    "payload_paths": f"""
SELECT regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path,
       CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
                 WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' ELSE 'whole' END AS kind, count(*) AS n
FROM (SELECT * FROM {_T} WHERE json_valid(details)), json_tree(details) GROUP BY ALL
UNION ALL SELECT '$', {_STATE}, count(*) FROM {_T} WHERE details IS NULL OR NOT json_valid(details) GROUP BY ALL""",
    "payload_groups": "SELECT 'whole' AS state, props ->> '$.k' AS key, count(*) AS n, round(sum(value), 2) AS value_sum FROM events GROUP BY ALL",
    "payload_broken": f"SELECT {_STATE} AS state, {_GOOD} ->> '$.at.user' AS key, count(*) AS n, round(sum(value), 2) AS value_sum FROM {_T} GROUP BY ALL",
    "payload_columns": f"SELECT event_id, event_type, {_STATE} AS details_state, {_GOOD} ->> '$.k' AS details_k, "
                       f"{_GOOD} ->> '$.tags' AS details_tags, {_GOOD} ->> '$.at' AS details_at FROM {_T}",
    "payload_types": "SELECT event_type, sum(CAST(props ->> '$.k' AS BIGINT))::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY 1",
}
