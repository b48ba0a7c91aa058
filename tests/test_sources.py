from __future__ import annotations

import hashlib

import pytest

from tablewright.operators import clean as C
from tablewright.plans import materialize as M
from tablewright.sources import files, layers


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "people.csv").write_text("name,age,salary\nAnn,30,100\nBob,40,200\nÇem,50,300\n", encoding="utf-8")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfname,age,salary\nDan,1,2\n")
    (tmp_path / "west.csv").write_bytes("name,age,salary\nJos\xe9 \u20ac\u201c,33,150\n".encode("cp1252"))
    (tmp_path / "latin.csv").write_bytes(b"name,age,salary\nX\x81\xe9,33,150\n")
    (tmp_path / "wide.csv").write_bytes("name,age,salary\nWide,9,8\n".encode("utf-16"))
    return tmp_path


def test_encodings(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in files.file_encodings(spark, str(folder)).collect()}
    assert got == {"people.csv": "utf-8", "bom.csv": "utf-8-sig", "west.csv": "cp1252", "latin.csv": "latin-1", "wide.csv": "utf-16"}


def test_late_bad_byte_is_seen(spark, tmp_path):
    (tmp_path / "late.csv").write_bytes(b"a\n" + b"x" * 300_000 + b"\xe9\n")
    assert files.file_encodings(spark, str(tmp_path)).first()["encoding"] == "cp1252"


def test_parts_of_a_folder_are_one_text(spark, tmp_path):
    mark, wide = b"\xef\xbb\xbf", "a\n".encode("utf-16")
    folders = {
        "plain": [b"a\n", "é\n".encode()], "west": [b"a\n", "é\n".encode(), b"\xe9\n"], "latin": [b"\xe9\n", "Á\n".encode()],
        "marked": [mark + b"a\n", mark + b"b\n"], "once": [mark + b"a\n", b"b\n"], "wide": [wide, wide], "mixed": [wide, b"\xe9\n"], "a+b %20 c": [b"\xe9\n"],
    }
    for name, parts in folders.items():
        (tmp_path / name).mkdir()
        for i, body in enumerate(parts):
            (tmp_path / name / f"part-{i}.csv").write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in files.file_encodings(spark, str(tmp_path), parts=True).collect()}
    assert got == {"plain": "utf-8", "west": "cp1252", "latin": "latin-1", "marked": "utf-8-sig", "once": "utf-8", "wide": "utf-16", "mixed": "cp1252", "a+b %20 c": "cp1252"}


def test_no_task_writes_all_of_a_language_or_status(spark, tmp_path):
    from workload import sources

    texts = [(["de", "en", "fr", None][i % 4], "plain" if i else "Stra\u00dfe \u4e2d") for i in range(400)]
    spark.createDataFrame(texts, "lang string, text string").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    keys = [(i, "OFP"[i % 3]) for i in range(300)]
    spark.createDataFrame(keys, "o_orderkey long, o_orderstatus string").repartition(6).write.parquet(str(tmp_path / "orders.parquet"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "2000")
    made: list[str] = []
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(sources, "_scratch", lambda spark, name: made.append(str(tmp_path / name)) or made[-1])
            assert sorted(map(tuple, sources.file_encodings(spark, str(tmp_path)).collect())) == [("de", "cp1252"), ("en", "utf-8"), ("fr", "utf-8")]
            assert list(map(tuple, sources.file_manifest(spark, str(tmp_path)).collect())) == [(".csv", "ok", 3, sum(len(str(i)) + 1 for i, _ in keys))]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(made) == 2 and all(len(list((tmp_path / at).glob("*/part-*"))) > 3 for at in made)


def test_every_file_is_read_in_its_own_encoding(spark, folder):
    df = files.read_csv_any_encoding(spark, str(folder), schema="name string, age long, salary long")
    assert {r["name"] for r in df.collect()} == {"Ann", "Bob", "Çem", "Dan", "José €“", "X\x81é", "Wide"}


def test_csv_infers_header_and_types(spark, folder):
    df = files.read_csv(spark, str(folder / "people.csv"))
    assert dict(df.dtypes) == {"name": "string", "age": "int", "salary": "int"} and df.count() == 3


def test_empty_is_refused_and_malformed_is_tolerated(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("col1,col2\n")
    with pytest.raises(files.DataLoadError):
        files.require_rows(files.read_csv(spark, str(tmp_path / "empty.csv")))
    (tmp_path / "bad.csv").write_text('a,b\n1,2\n"open,3\n4,5,6\n')
    assert files.read_csv(spark, str(tmp_path / "bad.csv")).count() >= 1
    strict = files.read_csv(spark, str(tmp_path / "bad.csv"), schema="a int, b int", skip_bad_lines=True)
    assert [tuple(r) for r in strict.collect()] == [(1, 2)]


def test_manifest_and_hash(spark, folder):
    (folder / "notes.txt").write_text("x")
    (folder / "none.csv").write_text("")
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in files.file_manifest(spark, str(folder), max_bytes=40).collect()}
    assert (status["notes.txt"], status["none.csv"], status["bom.csv"], status["wide.csv"]) == ("unsupported", "empty", "ok", "too_large")
    row = {r["path"].rsplit("/", 1)[1]: r for r in files.file_hashes(spark, str(folder)).collect()}["people.csv"]
    digest = hashlib.sha256((folder / "people.csv").read_bytes()).hexdigest()
    assert (row["sha256"], row["short_hash"]) == (digest, digest[:16])


def test_csv_round_trip_keeps_quotes_and_commas(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", twice'), (2, None), (3, "plain")], "k int, t string")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), schema="k int, t string")
    assert {tuple(r) for r in back.collect()} == {(1, 'say "hi", twice'), (2, None), (3, "plain")}


def test_layers(spark, tmp_path):
    root, df = str(tmp_path / "lake"), spark.range(10)
    import datetime as dt
    a = layers.store_bronze(df, root, "d", dt.datetime(2024, 1, 1))
    b = layers.store_bronze(df.limit(4), root, "d", dt.datetime(2024, 1, 2))
    assert layers.load_bronze(spark, root, "d", a).count() == 10
    assert layers.load_bronze(spark, root, "d").count() == 14
    assert [(r["load_ts"], r["row_count"]) for r in layers.list_bronze(spark, root).collect()] == [(b, 4), (a, 10)]
    silver = layers.store_silver(C.drop_duplicates(df), root, "d", a)
    layers.store_silver(C.drop_duplicates(df), root, "d", a)
    assert spark.read.parquet(silver).count() == 10
    paths = layers.store_gold({"t": df, "u": df.limit(1)}, root, "d")
    assert [spark.read.parquet(p).count() for p in paths] == [10, 1]


def test_checkpoint_folder_is_the_configured_one(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    assert M.ensure_checkpoint_dir(spark) == (before or spark.sparkContext.getCheckpointDir())
    assert M.materialize(spark.range(3)).count() == 3
