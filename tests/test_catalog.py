from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import catalog as G
from tablewright.operators import search as X


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture(scope="module")
def versions(spark):
    rows = [(v, c, t) for v, cols in {
        1: {"a": "int", "b": "string"}, 9: {"a": "bigint", "b": "string", "c": "double"}, 10: {"a": "bigint", "d": "double", "b": "string"},
    }.items() for c, t in cols.items()]
    return spark.createDataFrame([("ds", v, at(v), c, t) for v, c, t in rows] + [("other", 1, at(1), "z", "int")],
                                 "dataset string, version int, ts timestamp, column_name string, data_type string")


def test_latest_version_is_the_highest_number(versions):
    assert G.next_version(versions, "ds") == 11 and G.next_version(versions, "new") == 1
    assert {r["column_name"] for r in G.latest_schema(versions, "ds").collect()} == {"a", "b", "d"}
    assert {r["version"]: r["column_count"] for r in G.list_versions(versions, "ds").collect()} == {1: 2, 9: 3, 10: 3}


def test_changes_and_renames(versions):
    changes = G.schema_changes(versions, "ds", 9, 10)
    assert {(r["column_name"], r["change"]) for r in changes.collect()} == {("c", "removed"), ("d", "added")}
    renames = G.rename_candidates(changes)
    assert [tuple(r) for r in renames.collect()] == [("c", "d", "double")]
    assert G.change_summary(changes, renames).first()["summary"] == (
        "added=1; removed=1; maybe_renamed=1"
    )
    none = G.schema_changes(versions, "ds", 9, 9)
    summary = G.change_summary(none, G.rename_candidates(none)).first()
    assert (summary["has_changes"], summary["summary"]) == (False, "unchanged")


def test_history_follows_listed_versions(versions):
    got = {(r["old_version"], r["new_version"], r["column_name"], r["change"]) for r in G.schema_history(versions, "ds").collect()}
    assert got == {(1, 9, "a", "type_changed"), (1, 9, "c", "added"), (9, 10, "c", "removed"), (9, 10, "d", "added")}
    assert G.schema_history(versions, "other").count() == 0


def test_boolean_columns_are_not_numeric(spark):
    schema = {r["column_name"]: r for r in G.detect_schema(spark.createDataFrame([(True, 1), (None, 2)], "f boolean, n int")).collect()}
    assert (schema["f"]["column_category"], schema["f"]["nullable"], schema["f"]["unique_value_count"]) == ("boolean", True, 1)


def test_lineage(spark):
    events = spark.createDataFrame([("ds", "raw_dataset"), ("ds", "raw_dataset"), ("x", "dashboard"), ("ds", "odd")], "dataset string, stage_id string")
    rows = {r["stage_id"]: r for r in G.lineage_status(events, "ds").collect()}
    assert len(rows) == 9 and rows["raw_dataset"]["completed"] and not rows["dashboard"]["completed"]
    assert rows["raw_dataset"]["previous_stage"] is None and rows["bronze_storage"]["previous_stage"] == "raw_dataset"


def test_merged_registry_keeps_old_fields_and_honours_deletes(spark):
    log = spark.createDataFrame([
        ("a", at(1), "upsert", "first", "ann"), ("a", at(2), "upsert", None, "bob"),
        ("b", at(1), "upsert", "gone", "ann"), ("b", at(2), "delete", None, None), ("b", at(3), "upsert", None, "cy"),
        ("c", at(1), "upsert", "x", "ann"), ("c", at(2), "delete", None, None),
    ], "name string, ts timestamp, op string, description string, owner string")
    got = {r["name"]: (r["description"], r["owner"], r["created"], r["updated"]) for r in
           G.merged_registry(log, "name", ["description", "owner"], ["ts"], op="op").collect()}
    assert got == {"a": ("first", "bob", at(1), at(2)), "b": (None, "cy", at(3), at(3))}


def test_latest_and_version_history(spark):
    log = spark.createDataFrame([("a", at(1), 1), ("a", at(3), 2), ("a", at(2), 1), ("b", at(1), 5)], "k string, ts timestamp, v int")
    assert {tuple(r) for r in G.latest_per_key(log, ["k"], ["ts"]).select("k", "v").collect()} == {("a", 2), ("b", 5)}
    assert {tuple(r) for r in G.version_history(log, "k", "v", "ts").collect()} == {("a", 1, at(1)), ("a", 2, at(3)), ("b", 5, at(1))}


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(3):
        G.append_log(spark.createDataFrame([("ds", at(i), "read" if i else "write")], "dataset string, ts timestamp, action string"), path)
    log = spark.read.parquet(path)
    assert [r["action"] for r in G.recent(log, 2, ["ts"], dataset="ds").collect()] == ["read", "read"]
    assert G.recent(log, 5, ["ts"], action="write").count() == 1
    assert G.retained(log, "ts", 1).count() >= 1 and G.retained(log, "ts", 10_000).count() == 3
    assert G.retained(log.limit(0), "ts", 1).count() == 0


def test_run_stats(spark):
    runs = spark.createDataFrame([("a", at(1), 10.0, "success"), ("b", at(2), 20.0, "failed"), ("c", at(0), 33.0, "success")],
                                 "dataset string, ts timestamp, duration_ms double, status string")
    assert tuple(G.run_stats(runs, ["ts"]).first()) == (3, 21.0, 66.7, "b", "failed")
    assert G.run_stats(runs.limit(0), ["ts"]).first()["total_runs"] == 0


def test_search(spark):
    entries = spark.createDataFrame([("Sales", None, "Ann"), ("Stock", "monthly SALES", "Bob"), ("x", "y", "z")], "name string, description string, owner string")
    assert G.catalog_search(entries, "sales", ["name", "description", "owner"]).count() == 2
    assert [r["name"] for r in X.keyword_search(entries, "BOB zzz", ["name", "description", "owner"], ["name"]).collect()] == ["Stock"]


def test_vector_topk_matches_numpy(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 16)).astype("float32")
    q = rng.normal(size=16)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(300, [0.0] * 16)], "id long, v array<float>").repartition(4)
    got = [(r["id"], r["score"]) for r in X.vector_topk(df, "v", "id", list(q), 7).collect()]
    cos = (m @ q) / np.linalg.norm(m, axis=1) / np.linalg.norm(q)
    best = np.argsort(-cos)[:7]
    assert [i for i, _ in got] == list(best) and [s for _, s in got] == pytest.approx(cos[best], abs=1e-4)
