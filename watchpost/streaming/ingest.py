"""Continuous ingest of a drop folder with Structured Streaming.

The reference ingests an uploaded export and records a metric snapshot for
it.  Here the drop folder is a file stream: each micro-batch of new export
rows is typed and cleaned, appended to the dataset's Parquet store, and a
snapshot of the store's metrics is appended to the timeline.

Snapshots are incremental.  A snapshot holds whole-store metrics, but an
epoch only reads its own rows: it writes its additive counts (total, open,
severities, states, leaked, bypassed) and the org and repo values that no
earlier epoch has seen (epoch values anti-join the stored values).  The
snapshot is the sum of the per-epoch counts plus the number of stored
distinct values: small tables, however large the store grows.

Exactly-once: ``foreachBatch`` may replay an epoch after a failure, so each
epoch writes its own store, count and value folders in overwrite mode (a
replay replaces, never duplicates; values are compared with *earlier* epochs
only, so a replay computes the same set), and its snapshot is keyed by the
epoch id (a replay is skipped by the timeline's anti join).  The streaming
checkpoint must live on shared storage; pass a folder under
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchpost.functions.clean import empty_to_null, try_timestamp
from watchpost.functions.scalar import flag_text
from watchpost.operators import timeline as tl
from watchpost.schema import (
    ALERT_DATE_COLUMNS,
    ALERT_DISPLAY_COLUMNS,
    DEPS_COLUMNS,
    DISCOVERY_GLOBS,
    SECRET_DATE_COLUMNS,
    SECRET_DISPLAY_COLUMNS,
    all_string,
)
from watchpost.session import exists

_COLUMNS = {
    "alerts": ALERT_DISPLAY_COLUMNS,
    "secrets": SECRET_DISPLAY_COLUMNS,
    "deps": DEPS_COLUMNS,
}
_SOURCE = {"alerts": "dependabot", "secrets": "secrets"}


def _typed(df: DataFrame, dataset: str) -> DataFrame:
    if dataset == "deps":
        return empty_to_null(df)
    dates = ALERT_DATE_COLUMNS if dataset == "alerts" else SECRET_DATE_COLUMNS
    out = try_timestamp(df, dates)
    if "Alert_Number" in out.columns:
        out = out.withColumn("Alert_Number", F.col("Alert_Number").try_cast("long"))
    return out


def _epoch_counts(dataset: str, df: DataFrame) -> DataFrame:
    """The additive part of a snapshot over one epoch's rows (one row)."""
    state, c = F.col("State"), F.count_if
    if dataset == "alerts":
        sev = F.col("Severity")
        aggs = [
            c(state == "open").alias("open"),
            c(sev == "critical").alias("critical"), c(sev == "high").alias("high"),
            c(sev == "medium").alias("medium"), c(sev == "low").alias("low"),
            c(state == "fixed").alias("fixed"),
            c(state.isin("dismissed", "auto_dismissed")).alias("dismissed"),
        ]
    else:
        aggs = [
            c(state == "open").alias("open"),
            c(flag_text("Publicly_Leaked")).alias("leaked"),
            c(flag_text("Push_Protection_Bypassed")).alias("bypassed"),
        ]
    return df.agg(F.count(F.lit(1)).alias("total"), *aggs)


_DISTINCT = {"orgs": "Organization_Name", "repos": "Repository_Name"}


def _record_epoch(spark: SparkSession, state_dir: str, dataset: str, epoch_rows: DataFrame,
                  epoch_id: int) -> DataFrame:
    """Write this epoch's counts and first-seen values; return the whole-store
    metrics (one row) from the per-epoch state."""
    _epoch_counts(dataset, epoch_rows).write.mode("overwrite").parquet(
        f"{state_dir}/counts/epoch={epoch_id}")
    for kind, col in _DISTINCT.items():
        values = epoch_rows.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
        if exists(spark, f"{state_dir}/{kind}"):  # not before the first epoch
            seen = spark.read.parquet(f"{state_dir}/{kind}").where(F.col("epoch") < epoch_id)
            values = values.join(seen.select("value"), "value", "left_anti")
        values.write.mode("overwrite").parquet(f"{state_dir}/{kind}/epoch={epoch_id}")
    counts = spark.read.parquet(f"{state_dir}/counts").drop("epoch")
    totals = counts.agg(*[F.sum(c).cast("long").alias(c) for c in counts.columns])
    distinct = [
        spark.read.parquet(f"{state_dir}/{kind}").agg(F.count(F.lit(1))).scalar().alias(kind)
        for kind in _DISTINCT
    ]
    return totals.select("*", *distinct)


def start(spark: SparkSession, folder: str, dataset: str, store_root: str, checkpoint: str,
          columns: list[str] | None = None, available_now: bool = True,
          processing_time: str | None = None,
          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start ingesting new ``<glob>`` files of ``folder`` into ``store_root``.

    ``columns`` is the export header (CSV streams need a schema up front);
    it defaults to the dataset's display columns.  ``available_now`` drains
    what is there and stops; otherwise ``processing_time`` sets the trigger.
    ``max_files_per_trigger`` bounds one micro-batch when a backlog of
    exports lands at once.
    """
    cols = columns or _COLUMNS[dataset]
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = (
        reader.schema(all_string(cols))
        .option("header", True)
        # A file whose header has other names or another order raises, instead of being read by position.
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", DISCOVERY_GLOBS[dataset])
        .csv(folder)
    )
    store_dir = f"{store_root.rstrip('/')}/{dataset}"
    state_dir = f"{store_root.rstrip('/')}/_stream_state/{dataset}"
    history = tl.store_path(store_root)

    def batch(df: DataFrame, epoch_id: int) -> None:
        epoch_dir = f"{store_dir}/epoch={epoch_id}"
        _typed(df, dataset).write.mode("overwrite").parquet(epoch_dir)
        if dataset in _SOURCE:
            # Everything below reads this epoch's rows back from the store
            # (columnar, already typed), never the whole store.
            epoch_rows = spark.read.parquet(epoch_dir)
            metrics = _record_epoch(spark, state_dir, dataset, epoch_rows, epoch_id)
            tl.append(spark, history, tl.from_metrics(metrics, _SOURCE[dataset], f"epoch-{epoch_id}"))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_store(spark: SparkSession, store_root: str, dataset: str) -> DataFrame:
    """Everything ingested so far (all epochs)."""
    return spark.read.parquet(f"{store_root.rstrip('/')}/{dataset}").drop("epoch")
