"""Exact order statistics without sorting the data and without gathering it anywhere.

The value at a given rank is found by narrowing: count rows in equal-width cells between the known
bounds, keep the cell that holds the rank, repeat until a cell holds one value or few rows.  Each
round is one scan with partial aggregation; its result has at most CELLS rows per cell searched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.semantics import kind_of, quoted
from tablewright.plans.materialize import materialize
from tablewright.plans.stats import pin

CELLS = 4096
# A cell with no more rows than this is finished by ranking its distinct values.
SMALL_CELL = 50_000
# Groups of up to this many values use Spark's own percentile, which keeps a group's values in memory.
DIRECT_VALUES = 200_000
# A quantile sketch with this parameter is hardly ever off by more than a share of 0.0024; ranges taken from it
# reach this far, and who uses them counts what they hold.
SKETCH, BRACKET = 2_000, 0.004
# Ranges that one aggregate counts, so that generated code stays small enough to compile.
RANGES_PER_PASS = 40
# Sketches that one aggregate builds.
SKETCHES_PER_PASS = 50
# Search states up to this many rows, and this many characters of group keys in all, are broadcast
# (about 60 bytes each besides the key); beyond either they are salted.
BROADCAST_STATES = 100_000
BROADCAST_KEY_CHARS = 10_000_000
SALTS = 16
# Even cells take 12 bits off a range; every third round uses logarithmic ones, so that few rounds are needed.
MOST_ROUNDS = 200


def cell_of(kind: T.DataType, logarithmic: bool) -> Column:
    """The cell of v between lo and hi.  lo lies in the first and hi in another cell, so that every round narrows.

    Whole numbers are compared by their leading bits, exactly at any size.  Doubles lie in even cells, or in
    cells of their power of two, always so where a bound is infinite: the next bounds are then finite.
    """
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        span = hi.cast("double") - lo.cast("double")
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(1.0)) / CELLS)) + 1).cast("int")
        shifted = lambda c: F.call_function("shiftright", c.cast("bigint"), bits)
        return shifted(v) - shifted(lo)
    v, lo, hi = v.cast("double"), lo.cast("double"), hi.cast("double")
    power = lambda c: F.when(c == 0, 0.0).otherwise(F.signum(c) * F.least(F.lit(2101.0), F.log2(F.abs(c)) + 1076))
    steps = F.floor((power(v) - power(lo)) / (power(hi) - power(lo)) * (CELLS - 1))
    uneven = F.when(power(hi) > power(lo), steps)
    width = hi / 2 - lo / 2
    even = F.least(F.lit(CELLS - 1), F.floor((v / 2 - lo / 2) / width * CELLS))
    even = F.when(width > 0, even).otherwise(F.when(v > lo, 1).otherwise(0))
    infinite = (lo == float("-inf")) | (hi == float("inf"))
    return F.coalesce(F.when(infinite | F.lit(logarithmic), uneven), F.when(~infinite, even), F.when(v > lo, 1).otherwise(0))


def present_values(items: DataFrame) -> DataFrame:
    """Rows whose v is neither null nor NaN."""
    if isinstance(items.schema["v"].dataType, (T.FloatType, T.DoubleType)):
        return items.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return items.filter(F.col("v").isNotNull())


def _near(items: DataFrame, cells: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Rows of `items` that fall between the bounds of a cell of their group."""
    wanted = cells.select(*[F.col(k).alias(f"__c_{k}") for k in keys], "lo", "hi")
    match = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__c_{k}"))
    if small:
        joined = items.join(F.broadcast(wanted), match)
    else:
        # A group may hold a large share of the rows: spread each over SALTS tasks.
        salted = items.withColumn("__s", F.monotonically_increasing_id() % SALTS)
        salts = F.array(*[F.lit(i).cast("bigint") for i in range(SALTS)])
        spread = wanted.withColumn("__t", F.explode(salts))
        joined = salted.join(spread, match & (F.col("__s") == F.col("__t")))
    return joined.select(*keys, "v", "lo", "hi")


def _joined_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on nullable group keys and cell bounds."""
    names = [*keys, "lo", "hi"]
    match = None
    for k in names:
        right = right.withColumnRenamed(k, f"__r_{k}")
        same = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        match = same if match is None else match & same
    return left.join(right, match).drop(*[f"__r_{k}" for k in names])


def select_ranks(
    items: DataFrame | Callable[[list[str]], DataFrame], keys: Sequence[str], targets: DataFrame, *,
    few: bool = False,
) -> DataFrame:
    """The value at each wanted rank.

    items: keys..., v (numeric, never null).  Where the only key is a column name, items may be a
    function of the names still searched, so that a round reads no other columns.
    targets: keys..., n, rank (from 0), lo, hi where lo and hi are the bounds of the group's values, or of a
    range in it that holds the rank; then also below (values less than lo) and cnt (values in the range).
    Result: keys..., n, rank, v, below (rows less than v) and same (rows equal to v).

    The state of the search, one row per target, is kept between rounds: on the driver if there are
    `few` targets (a handful per column), otherwise in the checkpoint folder.
    """
    def settle(frame: DataFrame):
        """The state, computed, and what is to be known of it: targets open, unsettled, and its size."""
        wide = (F.col("lo") < F.col("hi")) & (F.col("cnt") > SMALL_CELL)
        if few:
            rows = frame.collect()
            unsettled = [r for r in rows if r["lo"] < r["hi"]]
            still_open = sum(r["cnt"] > SMALL_CELL for r in unsettled)
            return frame.sparkSession.createDataFrame(rows, frame.schema), still_open, len(unsettled), True
        done = materialize(frame)
        seen = done.agg(
            F.count_if(wide).alias("open"), F.count_if(F.col("lo") < F.col("hi")).alias("unsettled"),
            F.count(F.lit(1)).alias("all"),
            F.sum(F.length(F.concat_ws("", *[F.col(k).cast("string") for k in keys]))).alias("chars"),
        ).first()
        small = seen["all"] <= BROADCAST_STATES and (seen["chars"] or 0) <= BROADCAST_KEY_CHARS
        return done, seen["open"], seen["unsettled"], small

    if "below" not in targets.columns:
        targets = targets.withColumns({"below": F.lit(0).cast("bigint"), "cnt": F.col("n")})
    state, still_open, unsettled, small = settle(targets.select(*keys, "n", "rank", "below", "cnt", "lo", "hi"))

    def items_of(cells: DataFrame) -> DataFrame:
        if not callable(items):
            return items
        return items(sorted(r[0] for r in cells.select(*keys).distinct().collect()))

    wide = (F.col("lo") < F.col("hi")) & (F.col("cnt") > SMALL_CELL)
    rounds = 0
    while still_open:
        rounds += 1
        if rounds > MOST_ROUNDS:
            raise RuntimeError(f"the search for order statistics has not ended after {MOST_ROUNDS} rounds")
        open_, closed = state.filter(wide), state.filter(~wide)
        cells = open_.select(*keys, "lo", "hi").distinct()
        near = _near(items_of(cells), cells, keys, small)
        counted = near.groupBy(
            *keys, "lo", "hi", cell_of(near.schema["v"].dataType, rounds % 3 == 0).alias("cell")
        ).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("c_lo"), F.max("v").alias("c_hi"))
        earlier = Window.partitionBy(*keys, "lo", "hi").orderBy("cell").rowsBetween(
            Window.unboundedPreceding, -1
        )
        counted = counted.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        left = F.col("rank") - F.col("below")
        narrowed = (
            _joined_on(open_, counted.drop("cell"), keys)
            .filter((left >= F.col("before")) & (left < F.col("before") + F.col("c")))
            .select(
                *keys, "n", "rank", (F.col("below") + F.col("before")).alias("below"),
                F.col("c").alias("cnt"), F.col("c_lo").alias("lo"), F.col("c_hi").alias("hi"),
            )
        )
        state, still_open, unsettled, small = settle(closed.unionByName(narrowed))

    done = state.filter(F.col("lo") == F.col("hi")).select(
        *keys, "n", "rank", F.col("lo").alias("v"), "below", F.col("cnt").alias("same")
    )
    if not unsettled:
        return done
    rest = state.filter(F.col("lo") < F.col("hi"))
    cells = rest.select(*keys, "lo", "hi").distinct()
    values = _near(items_of(cells), cells, keys, small).groupBy(*keys, "lo", "hi", "v").agg(
        F.count(F.lit(1)).alias("c")
    )
    earlier = Window.partitionBy(*keys, "lo", "hi").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    left = F.col("rank") - F.col("below")
    found = (
        _joined_on(rest, values, keys)
        .filter((left >= F.col("before")) & (left < F.col("before") + F.col("c")))
        .select(*keys, "n", "rank", "v", (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("same"))
    )
    return done.unionByName(found)


def group_quantiles(items: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """keys..., n, q: exact linearly interpolated quantiles of v per group, q an array as `probs`.

    Groups of up to DIRECT_VALUES values take the built-in percentile, larger ones are narrowed.
    """
    present = present_values(items.select(*keys, "v"))
    return _quantiles(present, present, keys, probs, few=False)


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """column_name, n, q for several numeric columns; a column without values has no row."""
    names = list(columns)
    spark, schema = df.sparkSession, "column_name string, n bigint, q array<double>"
    if not names:
        return spark.createDataFrame([], schema)
    values = {c: _number(df, c) for c in names}
    ends = _sketched(df, {c: (v, [float(p) for p in probs]) for c, v in values.items()})
    if max(e["n"] for e in ends.values()) <= DIRECT_VALUES:
        def items(wanted: Sequence[str]) -> DataFrame:
            wide = df.select(*[quoted(c).cast("double").alias(c) for c in wanted])
            return present_values(wide.unpivot([], [quoted(c) for c in wanted], "column_name", "v"))

        return items(names).groupBy("column_name").agg(
            F.count(F.lit(1)).alias("n"), F.percentile("v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    wanted = {}
    for c, e in ends.items():
        if e["n"]:
            for p, (lo, hi) in zip(probs, e["brackets"]):
                at = math.floor(float(p) * (e["n"] - 1))
                for rank in {at, min(at + 1, e["n"] - 1)}:
                    wanted.setdefault((c, rank), (lo, hi))
    held = _counted(df, {key: (values[key[0]], *bracket) for key, bracket in wanted.items()})
    rows = []
    for (c, rank), (lo, hi) in wanted.items():
        below, cnt = held[c, rank]
        e = ends[c]
        sure = below <= rank < below + cnt  # else the sketch was off, and the search starts from the ends
        rows.append((c, e["n"], rank, below, cnt, lo, hi) if sure else (c, e["n"], rank, 0, e["n"], e["lo"], e["hi"]))
    bounds: dict[str, tuple[float, float]] = {}
    for c, _, _, _, _, lo, hi in rows:
        old = bounds.get(c, (lo, hi))
        bounds[c] = (min(lo, old[0]), max(hi, old[1]))
    reach = {c: [(lo, hi) for k, _, _, _, _, lo, hi in rows if k == c] for c in bounds}

    def near(wanted: Sequence[str]) -> DataFrame:
        """Long rows of the columns, none but those in a range that is searched."""
        inside = {c: reduce(or_, [(values[c] >= F.lit(lo)) & (values[c] <= F.lit(hi)) for lo, hi in dict.fromkeys(reach[c])]) for c in wanted}
        some = df.filter(reduce(or_, inside.values())) if wanted else df.limit(0)
        wide = some.select(*[F.when(inside[c], values[c]).alias(c) for c in wanted])
        return wide.unpivot([], [quoted(c) for c in wanted], "column_name", "v").filter(F.col("v").isNotNull())

    targets = spark.createDataFrame(rows, "column_name string, n bigint, rank bigint, below bigint, cnt bigint, lo double, hi double")
    return _interpolated(select_ranks(near, ["column_name"], targets, few=True), ["column_name"], probs)


def _number(df: DataFrame, name: str) -> Column:
    """A column as a double, NaN as null."""
    v = quoted(name).cast("double")
    return F.when(~F.isnan(v), v) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else v


def _sketched(df: DataFrame, wanted: dict) -> dict:
    """{key: n, lo, hi, brackets} for {key: (value, shares)}, from one scan with mergeable quantile sketches.

    A bracket (lo, hi) reaches as far beyond a share as the sketch may be off; who uses it counts what it holds.
    """
    if len(wanted) > SKETCHES_PER_PASS:
        keys = list(wanted)
        parts = [keys[i : i + SKETCHES_PER_PASS] for i in range(0, len(keys), SKETCHES_PER_PASS)]
        return {key: e for part in parts for key, e in _sketched(df, {k: wanted[k] for k in part}).items()}
    values = df.select(*[v.alias(f"v{k}") for k, (v, _) in enumerate(wanted.values())])
    aggregates, places = [], {}
    for k, (key, (_, shares)) in enumerate(wanted.items()):
        asked = sorted({min(1.0, max(0.0, p + d)) for p in shares for d in (-BRACKET, BRACKET)})
        places[key] = (k, asked)
        v, at = F.col(f"v{k}"), F.array(*[F.lit(p) for p in asked])
        kind = values.schema[f"v{k}"].dataType.typeName()
        if kind in ("double", "long"):
            kind = "bigint" if kind == "long" else kind
            sketch = F.call_function(f"kll_sketch_agg_{kind}", v, F.lit(SKETCH))
            quantiles = F.when(F.count(v) > 0, F.call_function(f"kll_sketch_get_quantile_{kind}", sketch, at))
        else:
            quantiles = F.percentile_approx(v, at, F.lit(2 * SKETCH))
        aggregates += [F.count(v).alias(f"n{k}"), F.min(v).alias(f"lo{k}"), F.max(v).alias(f"hi{k}"), quantiles.alias(f"q{k}")]
    row = values.agg(*aggregates).first()
    out = {}
    for key, (k, asked) in places.items():
        found = dict(zip(asked, row[f"q{k}"] or []))
        lo, hi = row[f"lo{k}"], row[f"hi{k}"]
        ends = [(min(1.0, max(0.0, p - BRACKET)), min(1.0, max(0.0, p + BRACKET))) for p in wanted[key][1]]
        brackets = [(lo if a == 0 else found[a], hi if b == 1 else found[b]) for a, b in ends] if found else []
        out[key] = {"n": row[f"n{k}"], "lo": lo, "hi": hi, "brackets": brackets}
    return out


def _counted(df: DataFrame, wanted: dict) -> dict:
    """{key: (values less than lo, values from lo to hi)} for {key: (value, lo, hi)}, a scan for RANGES_PER_PASS ranges."""
    out, keys = {}, list(wanted)
    for i in range(0, len(keys), RANGES_PER_PASS):
        part = keys[i : i + RANGES_PER_PASS]
        aggregates = []
        for k, key in enumerate(part):
            v, lo, hi = wanted[key]
            aggregates += [F.count_if(v < F.lit(lo)).alias(f"b{k}"), F.count_if((v >= F.lit(lo)) & (v <= F.lit(hi))).alias(f"c{k}")]
        row = df.agg(*aggregates).first()
        out.update({key: (row[f"b{k}"], row[f"c{k}"]) for k, key in enumerate(part)})
    return out


def _quantiles(
    whole: DataFrame, items: DataFrame | Callable[[list[str]], DataFrame], keys: Sequence[str],
    probs: Sequence[float], few: bool,
) -> DataFrame:
    bounds = whole.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    bounds = pin(bounds) if few else materialize(bounds)

    def direct(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile("v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"),
        )

    sizes = bounds.agg(F.max("n").alias("largest"), F.min("n").alias("least")).first()
    if (sizes["largest"] or 0) <= DIRECT_VALUES:
        return direct(whole)
    small_groups = None
    if sizes["least"] <= DIRECT_VALUES:
        # there are at most rows / DIRECT_VALUES large groups
        large = bounds.filter(F.col("n") > DIRECT_VALUES).select(*[F.col(k).alias(f"__l_{k}") for k in keys])
        match = None
        for k in keys:
            same = F.col(k).eqNullSafe(F.col(f"__l_{k}"))
            match = same if match is None else match & same
        near = F.broadcast(large) if large.count() <= BROADCAST_STATES else large
        small_groups = direct(whole.join(near, match, "left_anti"))
        if not callable(items):
            items = items.join(near, match, "left_semi")
        bounds = bounds.filter(F.col("n") > DIRECT_VALUES)
    found = _narrowed(items, bounds, keys, probs, few)
    return found if small_groups is None else found.unionByName(small_groups)


def _narrowed(
    items: DataFrame | Callable[[list[str]], DataFrame], bounds: DataFrame, keys: Sequence[str],
    probs: Sequence[float], few: bool,
) -> DataFrame:
    ranks: list[Column] = []
    for p in probs:
        at = F.floor(F.lit(float(p)) * (F.col("n") - 1))
        ranks += [at, F.least(at + 1, F.col("n") - 1)]
    targets = bounds.withColumn("rank", F.explode(F.array_distinct(F.array(*ranks))))
    found = select_ranks(items, keys, targets, few=few)
    if few:
        return _interpolated(found, keys, probs)
    by_rank = found.groupBy(*keys, "n").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", F.col("v").cast("double")))).alias("m")
    )

    def at_prob(p: float) -> Column:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        k = F.floor(pos)
        low = F.element_at("m", k)
        high = F.element_at("m", F.least(k + 1, F.col("n") - 1))
        # a rank that is met exactly, and equal neighbours, need no weights (infinities would give NaN)
        return F.when((pos == k) | (low == high), low).otherwise(low + (high - low) * (pos - k))

    return by_rank.select(*keys, "n", F.array(*[at_prob(p) for p in probs]).alias("q"))


def _interpolated(found: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """As the end of `_quantiles`, for a handful of ranks per column read by the driver."""
    by_key: dict[tuple, dict[int, float]] = {}
    for r in found.collect():
        by_key.setdefault((*[r[k] for k in keys], r["n"]), {})[r["rank"]] = float(r["v"])
    rows = []
    for (*key, n), values in by_key.items():
        q = []
        for p in probs:
            k = math.floor(p * (n - 1))
            low, high = values[k], values[min(k + 1, n - 1)]
            part = p * (n - 1) - k
            q.append(low if part == 0 or low == high else low + (high - low) * part)
        rows.append((*key, n, q))
    fields = [found.schema[k] for k in keys] + [
        T.StructField("n", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType()))
    ]
    return found.sparkSession.createDataFrame(rows, T.StructType(fields))


def quantiles_on_driver(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, tuple[int, list[float]]]:
    """{column: (number of values, quantiles)}; one row per column is read."""
    if not columns:
        return {}
    return {r["column_name"]: (r["n"], list(r["q"])) for r in column_quantiles(df, columns, probs).collect()}


def _as_number(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(data_type, T.TimestampNTZType):
        seconds = F.hour(c) * 3600 + F.minute(c) * 60
        micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
        days = F.unix_date(c.cast("date")).cast("bigint")
        return (days * 86_400 + seconds) * 1_000_000 + micros
    if isinstance(data_type, T.DateType):
        return F.unix_date(c).cast("bigint")
    if kind_of(data_type) == "numeric":
        return c
    raise ValueError(f"cannot order by {data_type.simpleString()}; use a number, date or timestamp")


def _as_literal(v, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.TimestampType):
        return F.timestamp_micros(F.lit(v))
    if isinstance(data_type, T.TimestampNTZType):
        at = datetime(1970, 1, 1) + timedelta(microseconds=v)
        return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(data_type, T.DateType):
        return F.date_from_unix_date(F.lit(v).cast("int"))
    return F.lit(v).cast(data_type)


def order_cuts(
    df: DataFrame, order_by: Sequence[str], ranks: Callable[[int], Sequence[int]]
) -> tuple[int, list[list[Column]]]:
    """The number of rows n, and for each of `ranks(n)` the order key of the row standing there.

    Keys are literals.  `order_by` must identify rows, so that ties are broken.  Rows without a
    leading order value stand nowhere and are not counted.  A key is as long as it needs to be: where
    the leading column already singles out the row, it is that alone.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def items_of(rows: DataFrame, name: str) -> DataFrame:
        v = _as_number(quoted(name), types[name]).alias("v")
        return rows.select(F.lit(0).alias("g"), v).filter(F.col("v").isNotNull())

    def ends_of(items: DataFrame):
        return items.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()

    def values_at(items: DataFrame, ends, wanted: Sequence[int]) -> dict[int, tuple]:
        v = items.schema["v"].dataType.simpleString()
        targets = df.sparkSession.createDataFrame(
            [(0, ends["n"], int(r), ends["lo"], ends["hi"]) for r in sorted(set(wanted))],
            f"g int, n bigint, rank bigint, lo {v}, hi {v}",
        )
        found = select_ranks(items, ["g"], targets, few=True).collect()
        return {r["rank"]: (r["v"], r["below"], r["same"]) for r in found}

    def complete(key: list[Column], rows: DataFrame, rest: Sequence[str], left: int, same: int) -> list[Column]:
        """Add to a key shared by `same` rows what singles out the row at place `left` among them."""
        if (same == 1 and key) or not rest:
            return key
        if same <= SMALL_CELL:
            names = [_as_number(quoted(c), types[c]).alias(c) for c in rest]
            row = rows.select(*names).orderBy(*[quoted(c) for c in rest]).offset(left).limit(1).first()
            return key + [_as_literal(row[c], types[c]) for c in rest]
        items = items_of(rows, rest[0])
        return extend(key, rows, rest, left, values_at(items, ends_of(items), [left])[left])

    def extend(key: list[Column], rows: DataFrame, rest: Sequence[str], rank: int, found: tuple) -> list[Column]:
        v, below, same = found
        at = _as_literal(v, types[rest[0]])
        return complete([*key, at], rows.filter(quoted(rest[0]) == at), rest[1:], rank - below, same)

    lead = items_of(df, order_by[0])
    ends = ends_of(lead)
    n, wanted = ends["n"], list(ranks(ends["n"]))
    if n <= SMALL_CELL:
        rows = df.filter(quoted(order_by[0]).isNotNull())
        return n, [complete([], rows, order_by, r, n) for r in wanted]
    found = values_at(lead, ends, wanted)
    return n, [extend([], df, order_by, r, found[r]) for r in wanted]


def grouped_cuts(
    df: DataFrame, order_by: Sequence[str], groups: dict[str, Column], ranks: Callable[[int], Sequence[int]]
) -> dict[str, list[list[Column]]]:
    """For each group, a condition on rows, the order keys of the rows standing at `ranks(n)` of its n rows.

    All groups and ranks are searched together, in rounds of three scans that read the order columns only: a
    sketch of the column searched gives a range for each rank, counts verify it, and ranges of up to SMALL_CELL
    rows are put in order.  A larger range is narrowed again, or where it is one value, that of the next order
    column is.  Keys are as for `order_cuts`; rows without a leading order value stand nowhere.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def number(c: str) -> Column:
        v = _as_number(quoted(c), types[c])
        return v.cast("bigint") if isinstance(types[c], (T.ByteType, T.ShortType, T.IntegerType)) else v.cast("double") if isinstance(types[c], T.FloatType) else v

    there = {g: condition & quoted(order_by[0]).isNotNull() for g, condition in groups.items()}
    sizes = df.agg(*[F.count_if(c).alias(f"n{k}") for k, c in enumerate(there.values())]).first() if groups else []
    out: dict[str, list[list[Column] | None]] = {}
    open_ = []  # (group, place in its list, condition, rank, rows, order columns settled, key so far)
    for (g, condition), n in zip(there.items(), sizes):
        wanted = [int(r) for r in ranks(n)]
        out[g] = [None] * len(wanted)
        open_ += [(g, i, condition, r, n, 0, []) for i, r in enumerate(wanted)]
    rounds = 0
    while open_:
        rounds += 1
        if rounds > MOST_ROUNDS:
            raise RuntimeError(f"the search for order cuts has not ended after {MOST_ROUNDS} rounds")
        small = [t for t in open_ if t[4] <= SMALL_CELL or t[5] == len(order_by)]
        for (g, i, _, _, _, _, key), row in zip(small, _standing_at(df, {c: number(c) for c in order_by}, small)):
            out[g][i] = key + [_as_literal(row[c], types[c]) for c in order_by[len(key):]]
        large = [t for t in open_ if not (t[4] <= SMALL_CELL or t[5] == len(order_by))]
        if not large:
            break
        ends = _sketched(df, {k: (F.when(t[2], number(order_by[t[5]])), [t[3] / max(t[4] - 1, 1)]) for k, t in enumerate(large)})
        # Rows are compared as they are, not as numbers: that is cheap, and reaches the files.
        wanted = {k: tuple(_as_literal(v, types[order_by[t[5]]]) for v in ends[k]["brackets"][0]) for k, t in enumerate(large)}
        held = _counted(df, {k: (F.when(t[2], quoted(order_by[t[5]])), *wanted[k]) for k, t in enumerate(large)})
        open_ = []
        for k, (g, i, condition, rank, n, settled, key) in enumerate(large):
            (lo, hi), (below, cnt), c = wanted[k], held[k], order_by[settled]
            if ends[k]["n"] < n:
                raise ValueError(f"{c} has missing values, so {', '.join(order_by)} do not order the rows")
            if rank < below:  # the sketch was off: go on with what lies on that side
                open_.append((g, i, condition & (quoted(c) < lo), rank, below, settled, key))
            elif rank >= below + cnt:
                open_.append((g, i, condition & (quoted(c) > hi), rank - below - cnt, n - below - cnt, settled, key))
            elif ends[k]["brackets"][0][0] == ends[k]["brackets"][0][1]:
                open_.append((g, i, condition & (quoted(c) == lo), rank - below, cnt, settled + 1, [*key, lo]))
            else:
                open_.append((g, i, condition & (quoted(c) >= lo) & (quoted(c) <= hi), rank - below, cnt, settled, key))
    return out


def _standing_at(df: DataFrame, number: dict[str, Column], wanted: list[tuple]) -> list:
    """The order values of the row at each rank among the rows of its condition; all from one scan."""
    if not wanted:
        return []
    any_of = reduce(or_, [t[2] for t in wanted])
    marks = F.array_compact(F.array(*[F.when(t[2], F.lit(k)) for k, t in enumerate(wanted)]))
    rows = df.filter(any_of).select(F.explode(marks).alias("__t"), *[v.alias(c) for c, v in number.items()])
    placed = rows.withColumn("__p", F.row_number().over(Window.partitionBy("__t").orderBy(*[quoted(c) for c in number])) - 1)
    hit = reduce(or_, [(F.col("__t") == k) & (F.col("__p") == t[3]) for k, t in enumerate(wanted)])
    found = {r["__t"]: r for r in placed.filter(hit).collect()}
    return [found[k] for k in range(len(wanted))]


def up_to(order_by: Sequence[str], key: Sequence[Column]) -> Column:
    """True for rows that stand at or before the row with this order key."""
    out: Column | None = None
    for name, at in reversed(list(zip(order_by, key))):
        c = quoted(name)
        out = (c <= at) if out is None else (c < at) | ((c == at) & out)
    return out


def from_on(order_by: Sequence[str], key: Sequence[Column]) -> Column:
    """True for rows that stand at or after the row with this order key."""
    out: Column | None = None
    for name, at in reversed(list(zip(order_by, key))):
        c = quoted(name)
        out = (c >= at) if out is None else (c > at) | ((c == at) & out)
    return out
