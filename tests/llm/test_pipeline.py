"""The pipeline's stages against brute force, and the registered SQL of this subpackage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tablewright.llm import queries
from tests.llm.test_joins import ITEMS, ROWS, brute_components, brute_hits, brute_removal
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_query_equals_sql(spark, name):
    assert compare(queries.all_queries()[name](spark, DATA), connect(DATA), queries.all_sql()[name]) is None


#: Queries with a row for each row of another table than documents, or for something else.
TABLES = {"op4": "pages", "op11": None, "op12": "embeddings", "op13": None}


@pytest.mark.parametrize("name", sorted(n for n in queries.all_queries() if TABLES.get(n.split("_")[0], "") is not None))
def test_query_returns_every_row(spark, name):
    table = TABLES.get(name.split("_")[0], "documents")
    assert queries.all_queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return rows.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})


def test_one_of_each_group_stays(spark, docs):
    got = {r.doc_id for r in P.one_of_each_group(spark, docs, DATA).collect()}
    assert got == {d for d, (_, c) in brute_components(ROWS).items() if d == c}


def test_documents_without_an_id_or_with_a_shared_one_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a, 1), (None, b, 2), (None, a, 1), (5, a + " end", 3), (5, c, 4), (5, c, 0), (6, c + " end", 5), (7, None, 6), (None, None, 7)]
    own = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    for parts in (1, 5):
        got = sorted(((r.doc_id, r.text, r.n_chars) for r in P.one_of_each_group(spark, own.repartition(parts), DATA).collect()), key=str)
        assert got == sorted([(None, a, 1), (None, b, 2), (5, c, 0), (7, None, 6), (None, None, 7)], key=str)


def test_passages_go(spark, docs):
    got = {r.doc_id: (r.text, r.n_chars) for r in P.without_repeated_passages(spark, docs, DATA).collect()}
    want = {d: (dict(ROWS)[d] if not gone else kept) for d, (n, gone, kept) in brute_removal(ROWS).items() if not gone or gone < n}
    assert got == {d: (t, len(t)) for d, t in want.items()}


def test_contaminated_documents_go(spark, docs, tmp_path):
    rows = [(1, "x alpha, beta gamma y"), (2, "clean words"), (3, None), (None, "alpha beta gamma"), (None, "clean"), (4, "solo")]
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1), "text_hash": F.lit("q")})
    got = sorted(map(str, ((r.doc_id, r.text) for r in P.without_benchmark(spark, own, str(tmp_path)).collect())))
    assert got == sorted(map(str, (r for r in rows if not brute_hits(r[1], ITEMS)[4])))


def test_stages_on_edge_rows_and_nothing(spark, edge, none):
    for name, stage in P.STAGES:
        out = stage(spark, edge, DATA)
        assert out.columns[:5] == list(P.COLUMNS), name
        assert out.count() <= edge.count()
        assert stage(spark, none, DATA).count() == 0, name


def test_run(spark):
    kept = P.run(spark, DATA)
    assert kept.columns[:5] == list(P.COLUMNS)
    n = kept.count()
    assert 100 < n < 200 and kept.filter("n_pieces = 0").count() <= kept.filter("n_chars = 0").count()
