"""Facts and records of text files from splits that are read side by side, whatever a file's size.

A split's facts combine in any order or, for what depends on order, by where the split begins.  Lines end at
a byte that is part of no other UTF-8 character, so a file is valid if each line is.  Quotes are an automaton
of two states: a split yields by how many lines it turns the state over, and the turns before a split, added
up, tell the state it begins in.  With it each task finds whole records among its own lines; only the ends of
records that a split's border cuts apart are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.plans.materialize import materialize

#: Splits whose beginning states are sent to every executor up to so many; beyond, lines are shuffled by split.
BROADCAST_SPLITS = 200_000


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value (a line's bytes as they are), uri, block (where its split begins), size (of the file) and at (its order in the split).

    Files are split like any text.  A byte-order mark of UTF-8 is not part of the first line.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return lines.select(
        "value", F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"))


def path_of(uri: Column) -> Column:
    """A file's path as the file listing spells it, from its address."""
    plain = F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))
    return F.regexp_replace(plain, r"^([A-Za-z0-9]+):/+", "$1:/")


def byte_facts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """uri, size, valid (UTF-8 throughout), undefined (a byte that CP1252 leaves open), head (two bytes as hex), marked.

    `marked`: the lines and their ends are two or three bytes short of the file, which is a UTF-8 byte-order mark.
    """
    value = F.col("value").cast("binary")
    # The five bytes that CP1252 leaves undefined.
    undefined = F.decode(value, "ISO-8859-1").rlike("[\\x81\\x8D\\x8F\\x90\\x9D]")
    head = F.when(F.col("block") == 0, F.hex(F.substring(value, 1, 2)))
    return lines_of(spark, path).groupBy("uri").agg(
        F.max("size").alias("size"), F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.bool_or(undefined).alias("undefined"),
        F.min_by(head, F.struct("block", "at")).alias("head"),
        (F.max("size") - F.sum(F.octet_length("value") + 1) >= 2).alias("marked"))


def _turns(line: Column) -> Column:
    """1 for a line with an odd number of quotes, which begins or ends a quoted line break."""
    return F.pmod(F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit(""))), F.lit(2))


def quote_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """uri, block, turns, open (the split begins inside quotes), begun (the split where that record begins), cut (a border cuts a record)."""
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    splits = lines_of(spark, path).groupBy("uri", "block").agg(F.sum(_turns(latin)).alias("turns"))
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = splits.select(
        "uri", "block", "turns", (F.pmod(F.coalesce(F.sum("turns").over(before), F.lit(0)), F.lit(2)) == 1).alias("open"),
        F.last(F.when(F.col("turns") > 0, F.col("block")), ignorenulls=True).over(before).alias("begun"))
    ends_open = F.col("open") != (F.pmod("turns", F.lit(2)) == 1)
    return states.withColumn("cut", F.col("open") | ends_open)


_OUT = "uri string, begun long, block long, header boolean, record string"


def _glue(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Records that lie in one split (`whole`), or the ends of those that do not.

    Rows: uri, block, open, begun, turn, line, in order within each split.
    """
    schema = pa.schema([("uri", pa.string()), ("begun", pa.int64()), ("block", pa.int64()), ("header", pa.bool_()), ("record", pa.string())])
    split, uri, inside, waiting, carried, first = None, None, False, [], None, False

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def rest() -> list:  # what the split's end leaves open
        return [] if whole or not waiting else [(uri, split[1] if carried is None else carried, split[1], first, "\n".join(waiting))]

    for batch in batches:
        blocks, turns = batch.column(1).to_numpy(), batch.column(4).to_numpy()
        uris = batch.column(0)
        same = split is not None and (blocks == split[1]).all() and uris[0].as_py() == uris[-1].as_py() == uri and split[0] == uri
        if same and not inside and not first and not turns.any():  # nothing but records of a line
            if whole:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([uris, pa.nulls(n, pa.int64()), batch.column(1), pa.array(np.zeros(n, bool)), batch.column(5)], schema=schema)
            continue
        out = []
        names, opens, begun, lines = uris.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist()
        for k, (name, block, turn, line) in enumerate(zip(names, blocks.tolist(), turns.tolist(), lines)):
            if split != (name, block):
                if split is not None:
                    out += rest()
                split, uri, inside, waiting, carried, first = (name, block), name, opens[k], [], begun[k] if opens[k] else None, block == 0
            if inside or turn:
                waiting.append(line)
                inside ^= bool(turn)
                if inside:
                    continue
                if whole == (carried is None):
                    out.append((uri, None if whole else carried, block, first, "\n".join(waiting)))
                waiting, carried = [], None
            elif whole:
                out.append((uri, None, block, first, line))
            first = False
        if out:
            yield made(out)
    if split is not None and (out := rest()):
        yield made(out)


def csv_records(spark: SparkSession, path: str | list[str], charset: str = "UTF-8", states: DataFrame | None = None) -> DataFrame:
    """uri, header (the file's first record) and record: the records of delimited files, line breaks inside quotes included.

    Every file is read in as many tasks as it has splits.  A quote that nothing closes makes one record of all
    that follows it.  Blank records are left out.
    """
    states = materialize(quote_states(spark, path)) if states is None else states
    value = F.col("value")
    line = F.make_valid_utf8(value) if charset == "UTF-8" else F.decode(value.cast("binary"), charset)
    lines = lines_of(spark, path).select("uri", "block", "at", line.alias("line"))
    columns = ["uri", "block", "open", "begun", _turns(F.col("line")).cast("int").alias("turn"), "line"]

    def dealt(wanted: DataFrame) -> DataFrame:
        if wanted.count() <= BROADCAST_SPLITS:  # lines stay where they are read, in order
            return lines.join(F.broadcast(wanted), ["uri", "block"]).select(*columns)
        return lines.join(wanted, ["uri", "block"]).repartition("uri", "block").sortWithinPartitions("uri", "block", "at").select(*columns)

    whole = dealt(states.drop("cut")).mapInArrow(lambda b: _glue(b, True), _OUT).select("uri", "header", "record")
    ends = dealt(states.filter("cut").drop("cut")).mapInArrow(lambda b: _glue(b, False), _OUT)
    parts = F.array_sort(F.collect_list(F.struct("block", "record", "header")))
    glued = ends.groupBy("uri", "begun").agg(parts.alias("parts")).select(
        "uri", F.exists("parts", lambda p: p["header"]).alias("header"), F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    records = whole.unionByName(glued).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return records.filter(F.trim("record") != "")
