"""Schema versions, lineage, logs, registries and search, on logs read off the events and orders tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablewright.operators import catalog as G
from tablewright.operators import search as X
from tablewright.plans.materialize import ensure_checkpoint_dir, materialize
from tablewright.sources import commits
from workload.common import rounded, table, view

# Fixed in this module: which stage each kind of event stands for.
_STAGE = {"view": "raw_dataset", "click": "bronze_storage", "signup": "data_quality", "purchase": "kpi_aggregation", "error": "unknown_stage"}
_STAGE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STAGE.items()) + " END"

_RUNS = ["event_id", "event_type AS dataset", "ts", "value AS duration_ms",
         "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status"]
_ACCESS = ["event_id", "concat('user-', CAST(user_id AS STRING)) AS user_name", "event_type AS action", "props AS dataset", "ts"]
_SCORES = ["event_type AS dataset", "ts", "100 - value / 5 AS score"]
_CHANGES = ["event_id", "user_id", "ts", "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op",
            "CASE WHEN event_type = 'view' THEN props END AS description",
            "CASE WHEN event_type <> 'click' THEN event_type END AS owner"]

# Versions of the orders schema: 1, then 9 with changes, then 10 with further ones.
_V1 = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_V9 = ["o_orderkey", "CAST(o_custkey AS STRING) AS o_custkey", "o_orderstatus", "o_totalprice AS o_total", "o_orderdate",
       "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority"]
_V10 = ["o_orderkey", "CAST(o_custkey AS STRING) AS o_custkey", "o_orderstatus", "o_totalprice AS o_total",
        "o_orderpriority", "o_orderkey > 100 AS o_big"]
_TYPES = {
    1: ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"],
    9: ["bigint", "string", "string", "double", "timestamp_ntz", "string"],
    10: ["bigint", "string", "string", "double", "string", "boolean"],
}
_ITEMS = {1: _V1, 9: _V9, 10: _V10}


def _versions(spark, d):
    out = None
    for v, items in _ITEMS.items():
        schema = G.detect_schema(view(spark, d, "orders", items))
        rows = G.schema_version(schema, "orders", v, F.lit("2024-01-01").cast("timestamp"))
        out = rows if out is None else out.unionByName(rows)
    return materialize(out)


def detect_schema(spark, d):
    return G.detect_schema(view(spark, d, "orders", _V9))


def schema_versions(spark, d):
    return G.list_versions(_versions(spark, d), "orders").drop("ts")


def latest_schema(spark, d):
    return G.latest_schema(_versions(spark, d), "orders").select("version", "column_name", "data_type", "unique_value_count")


def schema_diff(spark, d):
    return G.schema_changes(_versions(spark, d), "orders", 1, 9)


def schema_renames(spark, d):
    return G.rename_candidates(G.schema_changes(_versions(spark, d), "orders", 1, 9))


def schema_summary(spark, d):
    changes = G.schema_changes(_versions(spark, d), "orders", 1, 9)
    return G.change_summary(changes, G.rename_candidates(changes))


def schema_history(spark, d):
    return G.schema_history(_versions(spark, d), "orders")


def schema_added(spark, d):
    v = _versions(spark, d)
    return G.columns_only_in(G.latest_schema(v, "orders", 10), G.latest_schema(v, "orders", 1))


def schema_removed(spark, d):
    v = _versions(spark, d)
    return G.columns_only_in(G.latest_schema(v, "orders", 1), G.latest_schema(v, "orders", 10))


def lineage_status(spark, d):
    return G.lineage_status(view(spark, d, "events", ["event_id", f"{_STAGE_CASE} AS stage_id"]))


_CLEARED = ["event_id", "ts", "user_id AS dataset", "CASE WHEN event_type = 'error' THEN 'cleared' ELSE event_type END AS stage_id"]


def lineage_cleared(spark, d):
    return G.since_cleared(view(spark, d, "events", _CLEARED), ["ts", "event_id"])


def access_log(spark, d):
    return G.recent(view(spark, d, "events", _ACCESS), 50, ["ts", "event_id"], action="click")


def recent_events(spark, d):
    return G.recent(table(spark, d, "events"), 50, ["ts", "event_id"])


def log_retained(spark, d):
    return G.retained(table(spark, d, "events"), "ts", 10)


def log_roundtrip(spark, d):
    path = f"{ensure_checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    G.append_log(view(spark, d, "events", _RUNS), path)
    return spark.read.parquet(path).groupBy("dataset", "status").agg(F.count(F.lit(1)).alias("n"))


def run_stats(spark, d):
    return G.run_stats(view(spark, d, "events", _RUNS), ["ts", "event_id"])


def quality_trend(spark, d):
    return G.quality_trend(view(spark, d, "events", _SCORES), "click")


def observability_summary(spark, d):
    return G.observability_summary(table(spark, d, "events"), view(spark, d, "events", _RUNS), table(spark, d, "orders"))


def latest_registry(spark, d):
    return G.latest_per_key(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


def merged_registry(spark, d):
    return G.merged_registry(view(spark, d, "events", _CHANGES), "user_id", ["description", "owner"], ["ts", "event_id"], op="op")


def version_history(spark, d):
    return G.version_history(table(spark, d, "events"), "user_id", "event_type", "ts")


def catalog_search(spark, d):
    return G.catalog_search(table(spark, d, "documents"), "Heoron", ["text", "source", "lang"]).select("doc_id", "source", "lang")


def vector_topk(spark, d):
    emb = table(spark, d, "embeddings")
    mean = emb.select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x"))
    query = [r["x"] for r in sorted(mean.collect(), key=lambda r: r["at"])]
    return X.vector_topk(emb, "embedding", "vec_id", query, 5)


def vector_matches(spark, d):
    """Every fiftieth vector against all."""
    emb = table(spark, d, "embeddings")
    wanted = emb.filter("vec_id % 50 = 0").select("vec_id", "embedding").orderBy("vec_id").collect()
    found = X.vector_matches(emb, "embedding", "vec_id", [(r["vec_id"], r["embedding"]) for r in wanted], 5)
    return found.withColumnRenamed("key", "vec_id")


_ODD_VECTORS = ["vec_id", "CASE WHEN vec_id % 11 = 0 THEN slice(embedding, 1, 7) WHEN vec_id % 13 <> 0 THEN embedding END AS embedding"]


def vector_lengths(spark, d):
    return X.vector_lengths(view(spark, d, "embeddings", _ODD_VECTORS), "embedding", 64)


def keyword_search(spark, d):
    return X.keyword_search(table(spark, d, "documents"), "heoron Éaux", ["source", "lang", "text"], ["doc_id"]).select("doc_id", "source", "lang")


# Two versions of orders whose columns have other names: four of the five hold the same values.
_NAMED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"]
_RENAMED = ["o_orderkey AS order_no", "o_custkey AS buyer", "o_orderstatus AS state", "o_orderpriority AS urgency", "o_totalprice * 2 + 0.001 AS amount", "o_orderdate"]


def schema_rename_matches(spark, d):
    old, new = (G.column_signatures(view(spark, d, "orders", items)) for items in (_NAMED, _RENAMED))
    return G.matched_renames(old, new)


def log_loads(spark, d):
    """Each kind of event as a load of its own; one is appended twice, one fails before it is listed."""
    path = f"{ensure_checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    runs = view(spark, d, "events", _RUNS)
    commits.write_attempt(runs.filter("dataset = 'view'").withColumn("day", F.to_date("ts")), path, "view", ["day"])
    for kind in ("click", "view", "click", "error"):
        G.append_log(runs.filter(F.col("dataset") == kind), path, kind)
    return commits.read_loads(spark, path).groupBy("load", "day", "status").agg(F.count(F.lit(1)).alias("n"))


_FEATURES = ["event_type AS dataset", "concat('f', CAST(user_id % 40 AS STRING)) AS name", "value AS version", "ts", "event_id"]


def feature_registry(spark, d):
    """The newest entry of each feature, which dataset and name tell apart."""
    return G.latest_per_key(view(spark, d, "events", _FEATURES), ["dataset", "name"], ["ts", "event_id"])


QUERIES = {
    "schema_rename_matches": schema_rename_matches,
    "log_loads": log_loads,
    "feature_registry": feature_registry,
    "detect_schema": detect_schema,
    "schema_versions": schema_versions,
    "latest_schema": latest_schema,
    "schema_diff": schema_diff,
    "schema_renames": schema_renames,
    "schema_summary": schema_summary,
    "schema_history": schema_history,
    "schema_added": schema_added,
    "schema_removed": schema_removed,
    "lineage_status": lineage_status,
    "lineage_cleared": lineage_cleared,
    "access_log": access_log,
    "recent_events": recent_events,
    "log_retained": log_retained,
    "log_roundtrip": log_roundtrip,
    "run_stats": run_stats,
    "quality_trend": quality_trend,
    "observability_summary": observability_summary,
    "latest_registry": latest_registry,
    "merged_registry": merged_registry,
    "version_history": version_history,
    "catalog_search": catalog_search,
    "vector_topk": vector_topk,
    "vector_matches": vector_matches,
    "vector_lengths": vector_lengths,
    "keyword_search": keyword_search,
}


def _name(item: str) -> str:
    return item.split(" AS ")[-1]


def _schema_sql(v: int) -> str:
    source = f"(SELECT {', '.join(_ITEMS[v])} FROM orders)"
    category = {"bigint": "numeric", "double": "numeric", "timestamp_ntz": "datetime", "boolean": "boolean"}
    return " UNION ALL ".join(
        f"SELECT {v} AS version, '{_name(i)}' AS column_name, '{t}' AS data_type, count({_name(i)}) < count(*) AS nullable, "
        f"count(DISTINCT {_name(i)}) AS unique_value_count, '{category.get(t, 'categorical')}' AS column_category FROM {source}"
        for i, t in zip(_ITEMS[v], _TYPES[v])
    )


_VERSIONS = " UNION ALL ".join(_schema_sql(v) for v in _ITEMS)
_DIFF = """
SELECT coalesce(a.column_name, b.column_name) AS column_name,
       CASE WHEN a.data_type IS NULL THEN 'added' WHEN b.data_type IS NULL THEN 'removed' ELSE 'type_changed' END AS change,
       a.data_type AS old_type, b.data_type AS new_type
FROM (SELECT * FROM v WHERE version = {old}) a FULL JOIN (SELECT * FROM v WHERE version = {new}) b ON a.column_name = b.column_name
WHERE a.data_type IS DISTINCT FROM b.data_type"""
_D19 = _DIFF.format(old=1, new=9)
_RENAMES = """
SELECT a.column_name AS old_name, b.column_name AS new_name, a.old_type AS shared_type
FROM d a JOIN d b ON a.change = 'removed' AND b.change = 'added' AND a.old_type = b.new_type"""
_STAGE_ROWS = ", ".join(
    f"({i}, '{s}', '{label}', {repr(G.STAGES[i - 1][0]) if i else 'CAST(NULL AS STRING)'})" for i, (s, label) in enumerate(G.STAGES)
)

def _values_sql(items: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{_name(i)}' AS c, typeof({i.split(' AS ')[0]}) AS t, ({i.split(' AS ')[0]})::VARCHAR AS v FROM orders" for i in items[:-1])


SQL = {
    "schema_rename_matches": f"""
WITH a AS ({_values_sql(_NAMED)}), b AS ({_values_sql(_RENAMED)}),
 na AS (SELECT c, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT c, count(*) AS n FROM b GROUP BY 1),
 p AS (SELECT a.c AS old_name, b.c AS new_name, any_value(a.t) AS t, count(*) AS n FROM a JOIN b USING (t, v) GROUP BY 1, 2),
 s AS (SELECT old_name, new_name, t, p.n / (na.n + nb.n - p.n) AS similarity FROM p JOIN na ON na.c = old_name JOIN nb ON nb.c = new_name),
 r AS (SELECT *, row_number() OVER (PARTITION BY old_name ORDER BY similarity DESC, new_name) AS x, row_number() OVER (PARTITION BY new_name ORDER BY similarity DESC, old_name) AS y FROM s)
SELECT old_name, new_name, CASE t WHEN 'BIGINT' THEN 'bigint' ELSE 'string' END AS data_type, similarity::DOUBLE AS similarity FROM r WHERE x = 1 AND y = 1 AND similarity >= 0.5""",
    "log_loads": "SELECT event_type AS load, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, count(*) AS n "
                 "FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL",
    "feature_registry": f"""
SELECT dataset, name, version, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, name ORDER BY ts DESC, event_id DESC) AS rn
FROM (SELECT {', '.join(_FEATURES)} FROM events)) WHERE rn = 1""",
    "detect_schema": f"SELECT * EXCLUDE (version) FROM ({_schema_sql(9)})",
    "schema_versions": f"SELECT 'orders' AS dataset, version, count(*) AS column_count FROM ({_VERSIONS}) GROUP BY 1, 2",
    "latest_schema": f"SELECT version, column_name, data_type, unique_value_count FROM ({_schema_sql(10)})",
    "schema_diff": f"WITH v AS ({_VERSIONS}) {_D19}",
    "schema_renames": f"WITH v AS ({_VERSIONS}), d AS ({_D19}) {_RENAMES}",
    "schema_summary": f"""
WITH v AS ({_VERSIONS}), d AS ({_D19}), r AS ({_RENAMES}),
 c AS (SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed,
              count(*) FILTER (WHERE change = 'type_changed') AS type_changes, (SELECT count(*) FROM r) AS renames FROM d)
SELECT *, added + removed + type_changes > 0 AS has_changes,
       'added=' || added || '; removed=' || removed || '; retyped=' || type_changes || '; maybe_renamed=' || renames AS summary FROM c""",
    "schema_history": f"WITH v AS ({_VERSIONS}) SELECT 1 AS old_version, 9 AS new_version, * FROM ({_D19}) "
                      f"UNION ALL SELECT 9, 10, * FROM ({_DIFF.format(old=9, new=10)})",
    "schema_added": f"WITH v AS ({_VERSIONS}) SELECT column_name FROM v WHERE version = 10 EXCEPT SELECT column_name FROM v WHERE version = 1",
    "schema_removed": f"WITH v AS ({_VERSIONS}) SELECT column_name FROM v WHERE version = 1 EXCEPT SELECT column_name FROM v WHERE version = 10",
    "lineage_status": f"""
WITH s(position, stage_id, label, previous_stage) AS (VALUES {_STAGE_ROWS}),
 e AS (SELECT {_STAGE_CASE} AS stage_id, count(*) AS n FROM events GROUP BY 1)
SELECT position, s.stage_id, label, n IS NOT NULL AS completed, coalesce(n, 0) AS n_events, previous_stage
FROM s LEFT JOIN e ON e.stage_id = s.stage_id""",
    "lineage_cleared": f"""
WITH t AS (SELECT {', '.join(_CLEARED)} FROM events), n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM t)
SELECT event_id, ts, dataset, stage_id FROM n
WHERE rn > coalesce((SELECT max(c.rn) FROM n c WHERE c.dataset = n.dataset AND c.stage_id = 'cleared'), 0)""",
    "access_log": f"SELECT {', '.join(_ACCESS)} FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "recent_events": "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "log_retained": "SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 10 DAY",
    "log_roundtrip": "SELECT event_type AS dataset, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, count(*) AS n "
                     "FROM events GROUP BY 1",
    "run_stats": """
SELECT count(*) AS total_runs, round(avg(value), 2) AS avg_duration_ms,
       round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) * 100, 1) AS success_rate,
       (SELECT event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_dataset,
       (SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_status
FROM events""",
    "quality_trend": "SELECT event_type AS dataset, ts, round(100 - value / 5, 2) AS score FROM events WHERE event_type = 'click'",
    "observability_summary": "SELECT 'events' AS source, count(*) AS n FROM events UNION ALL SELECT 'runs', count(*) FROM events "
                             "UNION ALL SELECT 'ingestions', count(*) FROM orders",
    "latest_registry": "SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
                       "ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "merged_registry": f"""
WITH t AS (SELECT {', '.join(_CHANGES)} FROM events),
 n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM t),
 g AS (SELECT user_id, max(rn) AS gone FROM n WHERE op = 'delete' GROUP BY 1),
 l AS (SELECT n.* FROM n LEFT JOIN g ON g.user_id = n.user_id WHERE op <> 'delete' AND (gone IS NULL OR rn > gone))
SELECT user_id, last(description ORDER BY rn) FILTER (WHERE description IS NOT NULL) AS description,
       last(owner ORDER BY rn) FILTER (WHERE owner IS NOT NULL) AS owner, min(ts) AS created, max(ts) AS updated FROM l GROUP BY 1""",
    "version_history": "SELECT user_id, event_type, min(ts) AS first_seen FROM events GROUP BY 1, 2",
    "catalog_search": "SELECT doc_id, source, lang FROM documents WHERE contains(lower(text), 'heoron') OR contains(lower(source), 'heoron') "
                      "OR contains(lower(lang), 'heoron')",
    "vector_topk": """
WITH x AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
 q AS (SELECT i, avg(x) AS q FROM x GROUP BY 1)
SELECT vec_id, round(sum(CAST(x AS DOUBLE) * q) / sqrt(sum(CAST(x AS DOUBLE) * x)) / sqrt(sum(q * q)), 4) AS score
FROM x JOIN q ON x.i = q.i GROUP BY vec_id ORDER BY sum(CAST(x AS DOUBLE) * q) / sqrt(sum(CAST(x AS DOUBLE) * x)) DESC, vec_id LIMIT 5""",
    "vector_matches": """
WITH s AS (SELECT q.vec_id AS query, x.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS score
    FROM embeddings q JOIN embeddings x ON q.vec_id % 50 = 0),
 n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query, place::INT AS place, vec_id, round(score, 4) AS score FROM n WHERE place <= 5""",
    "vector_lengths": "SELECT CASE WHEN vec_id % 11 = 0 THEN 'other length' WHEN vec_id % 13 <> 0 THEN 'whole' ELSE 'null' END AS state, count(*) AS n FROM embeddings GROUP BY 1",
    "keyword_search": "SELECT doc_id, source, lang FROM (SELECT *, lower(concat_ws(' ', source, lang, text)) AS t FROM documents) "
                      "WHERE contains(t, 'heoron') OR contains(t, 'éaux') ORDER BY doc_id LIMIT 5",
}
