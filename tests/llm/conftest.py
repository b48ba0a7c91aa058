from __future__ import annotations

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Tests run in one process, so a local folder is shared."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")


LONG = " ".join(f"w{i % 4999}x{i}" for i in range(60_000))

#: Nulls, emptiness, white space, short and long texts, repeated rows, texts beyond ASCII.
EDGE_ROWS = [
    (1, None, None), (2, "", "en"), (3, " \t\n ", "en"), (4, "one", "en"), (5, "one two three four five six seven", None),
    (6, "one two three four five six seven", "en"), (6, "one two three four five six seven", "en"), (7, LONG, "en"),
    (8, LONG + " end", "de"), (9, "Ünï cödé 中文 \U0001f600 ▁ mark", "fr"), (None, "no id but words", "en"), (None, None, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with edge cases, and further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(EDGE_ROWS, "doc_id long, text string, lang string")
    return rows.withColumns({
        "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit("clash"), "key": F.lit(1), "h": F.lit(2),
        "id": F.lit("x"), "n": F.lit(0), "ids": F.lit(None).cast("string"), "words": F.lit(3), "dedup": F.lit("d"),
        "text_hash": F.lit(9), "component_id": F.lit("c"), "next": F.lit("n"), "bucket": F.lit(4), "label": F.lit(7),
    })


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
