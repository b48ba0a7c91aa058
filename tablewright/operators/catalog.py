"""Schema versions, lineage, operational logs and registries as append-only tables.

Writers append rows; current state is the latest row per key, computed with combinable aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.semantics import kind_of, quoted
from tablewright.plans.joins import attach_aggregates
from tablewright.plans.stats import COLUMNS_PER_PASS, column_stats, comparable, distinct_counts
from tablewright.sources.commits import append_load

#: Hash functions of a column's signature.
SLOTS = 32

# The stages a dataset passes, in order.
STAGES = [
    ("raw_dataset", "Raw Dataset"),
    ("bronze_storage", "Bronze Layer"),
    ("data_profiling", "Data Profiling"),
    ("data_quality", "Quality Validation"),
    ("data_cleaning", "Silver Layer (Cleaning)"),
    ("feature_engineering", "Feature Engineering"),
    ("kpi_aggregation", "Gold Layer (KPIs)"),
    ("dashboard", "Dashboard Visualization"),
    ("ai_insights", "AI Insights"),
]


# ---- schema versions -------------------------------------------------------------------------

def detect_schema(df: DataFrame) -> DataFrame:
    """column_name, data_type, nullable (a value is missing), unique_value_count, column_category."""
    plain = [f.name for f in df.schema.fields if kind_of(f.dataType) != "nested"]
    both = column_stats(df, moments=False).join(
        F.broadcast(distinct_counts(df, plain)), "column_name", "left"
    )
    category = F.when(F.col("kind").isin("numeric", "datetime", "boolean"), F.col("kind")).otherwise("categorical")
    return both.select(
        "column_name", "data_type", (F.col("n_missing") > 0).alias("nullable"),
        F.coalesce("n_distinct", F.lit(0)).alias("unique_value_count"), category.alias("column_category"),
    )


def schema_version(schema: DataFrame, dataset: str, version: int, ts: Column | None = None) -> DataFrame:
    """The rows to append for one version of a dataset's schema."""
    at = F.current_timestamp() if ts is None else ts
    return schema.select(F.lit(dataset).alias("dataset"), F.lit(version).alias("version"), at.alias("ts"), "*")


def next_version(versions: DataFrame, dataset: str) -> int:
    """One more than the highest version so far."""
    top = versions.filter(F.col("dataset") == dataset).agg(F.max("version")).first()[0]
    return (top or 0) + 1


def list_versions(versions: DataFrame, dataset: str | None = None) -> DataFrame:
    """dataset, version, ts, column_count."""
    rows = versions if dataset is None else versions.filter(F.col("dataset") == dataset)
    return rows.groupBy("dataset", "version").agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("column_count")
    )


def latest_schema(versions: DataFrame, dataset: str, version: int | None = None) -> DataFrame:
    """The columns of a version; of the highest one (by number, not by name) if none is given."""
    rows = versions.filter(F.col("dataset") == dataset)
    if version is None:
        version = next_version(versions, dataset) - 1
    return rows.filter(F.col("version") == version)


def schema_changes(versions: DataFrame, dataset: str, old: int, new: int) -> DataFrame:
    """column_name, change (added, removed, type_changed), old_type, new_type."""
    a = latest_schema(versions, dataset, old).select("column_name", F.col("data_type").alias("old_type"))
    b = latest_schema(versions, dataset, new).select("column_name", F.col("data_type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
    )
    return a.join(b, "column_name", "full_outer").withColumn("change", change).filter(
        F.col("change").isNotNull()
    ).select("column_name", "change", "old_type", "new_type")


def rename_candidates(changes: DataFrame) -> DataFrame:
    """old_name, new_name, shared_type: removed and added columns of one type."""
    gone = changes.filter(F.col("change") == "removed").select(
        F.col("column_name").alias("old_name"), F.col("old_type").alias("shared_type")
    )
    come = changes.filter(F.col("change") == "added").select(
        F.col("column_name").alias("new_name"), F.col("new_type").alias("shared_type")
    )
    return gone.join(come, "shared_type").select("old_name", "new_name", "shared_type")


def column_signatures(df: DataFrame) -> DataFrame:
    """column_name, data_type, signature: of each column the least hashes of its values under SLOTS hash functions.

    Combinable, one scan of COLUMNS_PER_PASS columns at a time.  A column without values has no signature.
    """
    out = df.sparkSession.createDataFrame([], "column_name string, data_type string, signature array<bigint>")
    fields = [f for f in df.schema.fields if kind_of(f.dataType) != "nested"]
    for i in range(0, len(fields), COLUMNS_PER_PASS):
        part = fields[i:i + COLUMNS_PER_PASS]
        values = df.select(*[F.when(quoted(f.name).isNotNull(), F.xxhash64(comparable(f.name, f.dataType))).alias(f"h{k}") for k, f in enumerate(part)])
        slots = lambda k: F.array(*[F.min(F.xxhash64(F.lit(s), F.col(f"h{k}"))) for s in range(SLOTS)])
        rows = [
            F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.when(F.count(f"h{k}") > 0, slots(k)).alias("signature"))
            for k, f in enumerate(part)
        ]
        out = out.unionByName(values.agg(F.array(*rows).alias("r")).select(F.inline("r")))
    return out


def matched_renames(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """old_name, new_name, data_type, similarity: columns of two signature tables that are each other's best match.

    Only names that one side lacks are looked at, and only pairs of a type that share a slot meet, so columns
    that have nothing in common make no pair.  Similarity is the share of equal slots, at least `least`; ties go
    to the first name.  Each column has at most one partner.
    """
    def slots(own: DataFrame, other: DataFrame, side: str) -> DataFrame:
        gone = own.join(other.select("column_name"), "column_name", "left_anti").filter(F.col("signature").isNotNull())
        return gone.select(F.col("column_name").alias(side), "data_type", F.posexplode("signature").alias("slot", "least"))

    pairs = slots(old, new, "old_name").join(slots(new, old, "new_name"), ["data_type", "slot", "least"])
    scored = pairs.groupBy("old_name", "new_name", "data_type").agg((F.count(F.lit(1)) / SLOTS).alias("similarity")).filter(F.col("similarity") >= least)
    best = lambda side, other: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("similarity"), other)) == 1
    ranked = scored.withColumns({"a": best("old_name", "new_name"), "b": best("new_name", "old_name")})
    return ranked.filter("a AND b").drop("a", "b")


def change_summary(changes: DataFrame, renames: DataFrame) -> DataFrame:
    """One row: counts of added, removed and retyped columns, of rename candidates, and the ones that are not 0 as text."""
    counts = changes.agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "removed").alias("removed"),
        F.count_if(F.col("change") == "type_changed").alias("type_changes"),
        F.lit(1).alias("one"),
    ).join(renames.agg(F.count(F.lit(1)).alias("renames"), F.lit(1).alias("one")), "one").drop("one")
    parts = [
        ("added", "added=%d"), ("removed", "removed=%d"),
        ("type_changes", "retyped=%d"), ("renames", "maybe_renamed=%d"),
    ]
    said = F.concat_ws("; ", *[F.when(F.col(c) > 0, F.format_string(f, c)) for c, f in parts])
    summary = F.when(F.length(said) > 0, said).otherwise("unchanged")
    return counts.withColumn("has_changes", F.col("added") + F.col("removed") + F.col("type_changes") > 0).withColumn(
        "summary", summary
    )


def schema_history(versions: DataFrame, dataset: str) -> DataFrame:
    """old_version, new_version, column_name, change, old_type, new_type over consecutive versions."""
    rows = versions.filter(F.col("dataset") == dataset).select("version", "column_name", "data_type")
    listed = sorted(r["version"] for r in rows.select("version").distinct().collect())
    step = F.create_map(*[x for a, b in zip(listed, listed[1:]) for x in (F.lit(a), F.lit(b))]) if len(listed) > 1 else None
    if step is None:
        return rows.sparkSession.createDataFrame(
            [], "old_version int, new_version int, column_name string, change string, old_type string, new_type string"
        )
    follows = {b: a for a, b in zip(listed, listed[1:])}
    back = F.create_map(*[x for b, a in follows.items() for x in (F.lit(b), F.lit(a))])
    a = rows.filter(F.col("version") != listed[-1]).select(
        F.col("version").alias("old_version"), step[F.col("version")].alias("new_version"), "column_name",
        F.col("data_type").alias("old_type"),
    )
    b = rows.filter(F.col("version") != listed[0]).select(
        back[F.col("version")].alias("old_version"), F.col("version").alias("new_version"), "column_name",
        F.col("data_type").alias("new_type"),
    )
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
    )
    both = a.join(b, ["old_version", "new_version", "column_name"], "full_outer").withColumn("change", change)
    return both.filter(F.col("change").isNotNull()).select(
        "old_version", "new_version", "column_name", "change", "old_type", "new_type"
    )


def columns_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """column_name of the columns of one schema that the other lacks."""
    return left.select("column_name").subtract(right.select("column_name"))


# ---- lineage ---------------------------------------------------------------------------------

def stage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, s, label) for i, (s, label) in enumerate(STAGES)], "position int, stage_id string, label string"
    )


def lineage_status(events: DataFrame, dataset: str | None = None) -> DataFrame:
    """position, stage_id, label, completed, n_events, previous_stage for every stage."""
    rows = events if dataset is None else events.filter(F.col("dataset") == dataset)
    done = rows.groupBy("stage_id").agg(F.count(F.lit(1)).alias("n_events"))
    edges = F.create_map(*[x for a, b in zip(STAGES, STAGES[1:]) for x in (F.lit(b[0]), F.lit(a[0]))])
    return stage_table(events.sparkSession).join(done, "stage_id", "left").select(
        "position", "stage_id", "label", F.col("n_events").isNotNull().alias("completed"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"), edges[F.col("stage_id")].alias("previous_stage"),
    )


def since_cleared(events: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Lineage events after the dataset's last clearing, which is itself an event of stage `cleared`."""
    at = F.struct(*[quoted(c) for c in order_by])
    marked = attach_aggregates(
        events, "dataset", {"__cleared": F.max(at)}, source=events.filter(F.col("stage_id") == "cleared")
    )
    return marked.filter(F.col("__cleared").isNull() | (at > F.col("__cleared"))).drop("__cleared")


# ---- logs ------------------------------------------------------------------------------------

def append_log(rows: DataFrame, path: str, load: str | None = None) -> None:
    """Append rows with a `ts` column to a log, partitioned by day.

    With a `load` key the append can be repeated: see `sources.commits`, whose `read_loads` reads such a log.
    """
    rows = rows.withColumn("day", F.to_date("ts"))
    if load is not None:
        append_load(rows, path, load, ["day"])
    else:
        rows.write.mode("append").partitionBy("day").parquet(path)


def recent(log: DataFrame, limit: int, order_by: Sequence[str], **equal: str) -> DataFrame:
    """The newest `limit` entries, optionally of one dataset or type."""
    for name, value in equal.items():
        log = log.filter(quoted(name) == value)
    return log.orderBy(*[F.desc(c) for c in order_by]).limit(limit)


def retained(log: DataFrame, at: str, days: int) -> DataFrame:
    """The entries of the last `days` days before the newest one, whatever the log's size."""
    newest = log.agg(F.max(quoted(at)).alias("newest")).first()["newest"]
    return log if newest is None else log.filter(quoted(at) > F.lit(newest) - F.make_dt_interval(F.lit(days)))


def run_stats(runs: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """One row: total_runs, avg_duration_ms, success_rate, last_dataset, last_status."""
    at = F.struct(*[quoted(c) for c in order_by])
    last = F.max_by(F.struct("dataset", "status"), at)
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"),
        F.round(F.avg((F.col("status") == "success").cast("double")) * 100, 1).alias("success_rate"),
        last.alias("last"),
    ).select(
        "total_runs", "avg_duration_ms", "success_rate",
        F.col("last.dataset").alias("last_dataset"), F.col("last.status").alias("last_status"),
    )


def quality_trend(scores: DataFrame, dataset: str | None = None) -> DataFrame:
    """dataset, ts, score in time order."""
    rows = scores if dataset is None else scores.filter(F.col("dataset") == dataset)
    return rows.select("dataset", "ts", F.round("score", 2).alias("score")).orderBy("ts", "dataset")


def observability_summary(events: DataFrame, runs: DataFrame, ingestions: DataFrame) -> DataFrame:
    """source, n for events, runs and ingestions."""
    parts = [("events", events), ("runs", runs), ("ingestions", ingestions)]
    out = None
    for name, frame in parts:
        row = frame.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- registries ------------------------------------------------------------------------------

def latest_per_key(log: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The newest row of each key.  Rows are combined before the shuffle, whatever a key's share."""
    rest = [c for c in log.columns if c not in keys]
    at = F.struct(*[quoted(c) for c in order_by])
    newest = F.max_by(F.struct(*[quoted(c) for c in rest]), at)
    return log.groupBy(*keys).agg(newest.alias("__r")).select(*keys, *[F.col("__r").getField(c).alias(c) for c in rest])


def merged_registry(
    log: DataFrame, key: str, fields: Sequence[str], order_by: Sequence[str], op: str | None = None
) -> DataFrame:
    """Current entries from a change log of partial updates.

    Each field is its latest present value; `created` and `updated` are the first and last change.
    With `op`, a row whose op is 'delete' removes the entry and what came before it.
    """
    at = F.struct(*[quoted(c) for c in order_by])
    live = log
    if op is not None:
        marked = attach_aggregates(log, key, {"__gone": F.max(at)}, source=log.filter(quoted(op) == "delete"))
        live = marked.filter((quoted(op) != "delete") & (F.col("__gone").isNull() | (at > F.col("__gone"))))
    lead = quoted(order_by[0])
    return live.groupBy(key).agg(
        *[F.max_by(quoted(f), F.when(quoted(f).isNotNull(), at)).alias(f) for f in fields],
        F.min(lead).alias("created"),
        F.max(lead).alias("updated"),
    )


def version_history(log: DataFrame, key: str, version: str, at: str) -> DataFrame:
    """key, version, first time that version was registered."""
    return log.groupBy(key, version).agg(F.min(quoted(at)).alias("first_seen"))


def catalog_search(entries: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Entries with the query, ignoring case, inside any of the columns."""
    wanted = F.lit(query.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(quoted(c)).contains(wanted), F.lit(False))
    return entries.filter(hit)
