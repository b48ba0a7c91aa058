"""Files read in many splits give the facts and records of the whole, wherever the borders fall."""

from __future__ import annotations

import csv
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tablewright.sources import files, lines

RANDOM = random.Random(3)
ALPHABET = ["a", "Ä", "中", " ", ",", '"', "\n", "\r\n", "x" * 30, "é"]


def rows(n):
    return [(str(i), "".join(RANDOM.choices(ALPHABET, k=RANDOM.randrange(1, 9))) + "|", RANDOM.choice(["", "7", "2.5"])) for i in range(n)]


def written(data, end="\n", **options) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end, **options)
    writer.writerow(["k", "t, x", "n"])
    writer.writerows(data)
    return out.getvalue()


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "13")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("limit", [lines.BROADCAST_SPLITS, 0])
def test_records_over_many_splits(spark, tmp_path, small_splits, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_SPLITS", limit)
    data = {name: rows(n) for name, n in (("one", 40), ("two", 25), ("three", 1))}
    long = ("900", "start\n" + "middle line\n" * 60 + "end|", "1")  # a record over many splits
    data["two"].append(long)
    (tmp_path / "one.csv").write_bytes(written(data["one"]).encode())
    (tmp_path / "two.csv").write_bytes(b"\xef\xbb\xbf" + written(data["two"], "\r\n").encode())
    (tmp_path / "three.csv").write_bytes(written(data["three"]).rstrip("\n").encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    assert lines.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    df = files.read_csv(spark, str(tmp_path), schema="k string, t string, n string")
    plain = lambda t: t.replace("\r\n", "\n")  # noqa: E731  the reader's own line breaks
    got = sorted((r.k, plain(r.t), r.n or "") for r in df.collect())
    assert got == sorted((k, plain(t), n) for own in data.values() for k, t, n in own)
    inferred = files.read_csv(spark, str(tmp_path))
    assert [t for _, t in inferred.dtypes] == ["int", "string", "double"] and inferred.columns == ["k", "t, x", "n"]


def test_bad_records_are_counted_over_splits(spark, tmp_path, small_splits):
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_text('k,t\n1,"a\nb"\nx,"c"\n2,"d\n\n\ne"\n,\n\n3,"f" tail\n')
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("t", T.StringType())])
    r = files.bad_lines(spark, str(tmp_path), schema).first()
    assert (r.n_rows, r.n_bad, r.n_empty) == (5, 1, 1)
    strict = files.read_csv(spark, str(tmp_path), schema=schema, skip_bad_lines=True)
    assert sorted((x.k or 0, x.t) for x in strict.filter("t is not null").collect())[:2] == [(1, "a\nb"), (2, "d\n\n\ne")]


@pytest.mark.parametrize("body", [b"plain\nlines\n", b"no end", b"\n", b"a\n\n", b"a\r\nb\r\n", b"x" * 500, ("Straße 中 " * 40).encode()])
@pytest.mark.parametrize("mark", [b"", b"\xef\xbb\xbf"])
def test_hashes_and_encodings_of_split_files(spark, tmp_path, small_splits, body, mark):
    (tmp_path / "f one+two%.csv").write_bytes(mark + body)
    streamed = files.file_hashes(spark, str(tmp_path), large=0).first()
    whole = files.file_hashes(spark, str(tmp_path)).first()
    assert streamed == whole and whole.sha256 == hashlib.sha256(mark + body).hexdigest()
    found = files.file_encodings(spark, str(tmp_path)).first()
    assert found.encoding == ("utf-8-sig" if mark else "utf-8") and found.path == whole.path


def test_a_bad_byte_in_any_split_decides(spark, tmp_path, small_splits):
    for name, byte in (("west", b"\xe9"), ("east", b"\x81"), ("cut", "中".encode()[:2])):
        (tmp_path / name).write_bytes(b"line of text\n" * 40 + byte + b"\n" + b"more\n" * 40)
    got = {r.path.rsplit("/", 1)[1]: r.encoding for r in files.file_encodings(spark, str(tmp_path)).collect()}
    assert got == {"west": "cp1252", "east": "latin-1", "cut": "cp1252"}


def test_cp1252_records_with_line_breaks(spark, tmp_path, small_splits):
    (tmp_path / "w.csv").write_bytes(written([("1", "Jos\xe9 €\n“ok”", "2")]).encode("cp1252"))
    row = files.read_csv_any_encoding(spark, str(tmp_path), schema="k int, t string, n int").first()
    assert tuple(row) == (1, "José €\n“ok”", 2)


def test_quotes_that_even_out_need_no_gluing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n1,"a ""b"" c"\n')
    assert not files.quoted_line_breaks(spark, str(tmp_path))
    assert files.read_csv(spark, str(tmp_path)).select(F.first("t")).first()[0] == 'a "b" c'
