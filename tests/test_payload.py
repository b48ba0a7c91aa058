"""JSON in a column: paths, fields and groups, broken text counted."""

from __future__ import annotations

import pytest

from tablewright.operators import payload as P

TEXTS = [
    '{"k": 5, "tags": [1, "a", null], "at": {"u": 1.5, "b": true}}', '{"k": 2.5, "e": {}, "l": [], "a b": "x"}', '{"k', None, "null", "[1, [2]]", "", '"text"',
    '{"k": null, "it\'s": 1}',
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, j string").selectExpr("*", "id AS path", "'x' AS j_k", "1 AS `key`")


def test_paths_count_every_value(frame):
    got = {(r.path, r.kind): r.n for r in P.payload_paths(frame, "j").collect()}
    assert got == {
        ("$", "object"): 3, ("$", "array"): 1, ("$", "broken"): 2, ("$", "missing"): 1, ("$", "null"): 1, ("$", "string"): 1,
        ("$.k", "whole"): 1, ("$.k", "number"): 1, ("$.k", "null"): 1, ("$.tags", "array"): 1, ("$.tags[]", "whole"): 1, ("$.tags[]", "string"): 1,
        ("$.tags[]", "null"): 1, ("$.at", "object"): 1, ("$.at.u", "number"): 1, ("$.at.b", "boolean"): 1, ("$.e", "object"): 1, ("$.l", "array"): 1,
        ("$['a b']", "string"): 1, ("$['it's']", "whole"): 1, ("$[]", "whole"): 1, ("$[]", "array"): 1, ("$[][]", "whole"): 1,
    }


def test_columns_take_the_type_that_holds_all_values(frame):
    out = P.payload_columns(frame, "j")
    types = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    assert types["j_k"] == "string" and types["j_k_"] == "double" and types["j_tags"] == "string" and types["j_it's"] == "bigint"
    rows = {r.id: r for r in out.collect()}
    assert [rows[i]["j_k_"] for i in range(3)] == [5.0, 2.5, None] and rows[0]["j_at"] == '{"b":true,"u":1.5}' and rows[8]["j_it's"] == 1
    assert [rows[i]["j_state"] for i in range(9)] == ["whole", "whole", "broken", "missing", "whole", "whole", "broken", "whole", "whole"]


def test_keys_with_both_quotes(spark):
    out = P.payload_columns(spark.createDataFrame([('{"a\'\\"b": 7}',)], "j string"), "j")
    assert out.first()["j_a'\"b"] == 7


def test_groups_keep_broken_rows(frame):
    got = {(r.state, r.key): (r.n, r.id_sum) for r in P.group_by_payload(frame, "j", "$.k", "id").collect()}
    assert got == {("whole", "5"): (1, 0.0), ("whole", "2.5"): (1, 1.0), ("whole", None): (4, 24.0), ("broken", None): (2, 8.0), ("missing", None): (1, 3.0)}


def test_keys_that_are_data_are_refused(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_FIELDS", 5)
    rows = spark.range(6).selectExpr("concat('{\"k', id, '\": 1}') AS j")
    with pytest.raises(ValueError, match="payload_paths"):
        P.payload_columns(rows, "j")
    assert P.payload_paths(rows, "j").count() == 7


def test_empty_table(spark):
    none = spark.createDataFrame([], "j string")
    assert P.payload_paths(none, "j").collect() == [] and P.payload_columns(none, "j").columns == ["j", "j_state"]
