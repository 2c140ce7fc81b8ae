"""Append-only history of metric snapshots (``tl_*``).

Storage is a folder of batches, each a Parquet table partitioned by
``source``, and a log of commits under ``_log``: one small file per commit,
numbered without gaps, that names its batch.  A snapshot is keyed by
``(source, fingerprint)``; appending is "new candidates anti-join history",
so re-running an append (a retried job, a restarted app re-ingesting the same
file) inserts nothing twice.

An append reads the history of the last commit, writes its batch, and then
claims the next number, which only one appender can.  Another that loses the
race removes its batch and begins anew on the longer history.  So a key is
stored once and ids are distinct, whatever appenders run at a time, and a
batch without its commit (a lost job) is never read.  ``read_history`` still
keeps the first row per key (earliest timestamp, then lowest id), for tables
written before there was a log.
"""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchpost.functions.clean import iso_text, safe_int
from watchpost.functions.ordering import row_index
from watchpost.schema import (
    SNAPSHOT_KEY_ALIASES,
    SNAPSHOT_METRICS,
    SNAPSHOT_SCHEMA,
    ZOOM_IN_SHARE,
    ZOOM_OUT_SHARE,
)
from watchpost.session import claim_next, log_entries, log_entry, names, remove, scratch_dir

_LOG = "_log"
#: New keys of one append that are numbered in one task.
_ONE_TASK = 10_000
KEY = ["source", "fingerprint"]
ID_ORDER = ["timestamp", "source", "fingerprint"]


# ---- building candidates ---------------------------------------------------

def from_metrics(metrics: DataFrame, source: str, fingerprint: str | Column,
                 timestamp: datetime | Column | None = None) -> DataFrame:
    """Turn a one-row ``met_*`` frame into a snapshot candidate.

    Missing metrics are 0; ``publicly_leaked``/``push_bypassed`` feed
    ``leaked``/``bypassed``; every value goes through ``safe_int``.
    """
    cols = set(metrics.columns)
    out = []
    for m in SNAPSHOT_METRICS:
        alias = SNAPSHOT_KEY_ALIASES.get(m)
        if alias and alias in cols:
            out.append(safe_int(F.col(alias)).alias(m))
        elif m in cols:
            out.append(safe_int(F.col(m)).alias(m))
        else:
            out.append(F.lit(0).cast("long").alias(m))
    if timestamp is None:
        timestamp = datetime.now(timezone.utc)
    ts = timestamp if isinstance(timestamp, Column) else F.lit(timestamp).cast("timestamp")
    fp = fingerprint if isinstance(fingerprint, Column) else F.lit(fingerprint)
    return metrics.select(ts.alias("timestamp"), F.lit(source).alias("source"),
                          fp.alias("fingerprint"), *out)


def backfill(metrics: DataFrame, source: str, fingerprint: str,
             now: datetime | Column | None = None, days: int = 3) -> DataFrame:
    """tl_backfill: a candidate stamped ``days`` before ``now``."""
    now = now if now is not None else datetime.now(timezone.utc)
    past = now - (F.make_dt_interval(F.lit(days)) if isinstance(now, Column) else timedelta(days=days))
    return from_metrics(metrics, source, fingerprint, past)


# ---- append ------------------------------------------------------------------

def empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SNAPSHOT_SCHEMA)


def _committed(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of the last commit (0 if none), and the batches of all."""
    log = f"{path.rstrip('/')}/{_LOG}"
    numbers = log_entries(spark, log)
    with ThreadPoolExecutor(max_workers=16) as pool:
        batches = list(pool.map(lambda n: log_entry(spark, log, n), numbers))
    return (numbers[-1] if numbers else 0), batches


def _rows_of(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    old = [n for n in names(spark, path) if n.startswith("source=")]  # written without a log
    out = empty_history(spark)
    for folders in (batches, old):
        if folders:
            raw = spark.read.schema(SNAPSHOT_SCHEMA).option("basePath", path).parquet(
                *[f"{path.rstrip('/')}/{f}" for f in folders])
            out = out.union(raw.select(*SNAPSHOT_SCHEMA.names))
    return out


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every committed row."""
    return _rows_of(spark, path, _committed(spark, path)[1])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The stored history (one row per key), or an empty frame when nothing
    was recorded yet.  Filters on ``source`` prune partition folders."""
    return first_recorded(read_raw(spark, path))


def first_recorded(raw: DataFrame) -> DataFrame:
    """The first stored row of every key (earliest timestamp, then lowest id):
    what a reader sees even if racing appenders both wrote a key."""
    row = F.struct("timestamp", "id", *SNAPSHOT_METRICS)
    return raw.groupBy(*KEY).agg(F.min(row).alias("r")).select(
        F.col("r.id").alias("id"), F.col("r.timestamp").alias("timestamp"), *KEY,
        *[F.col(f"r.{m}").alias(m) for m in SNAPSHOT_METRICS],
    )


def first_per_key(candidates: DataFrame) -> DataFrame:
    """One candidate per key: the earliest (then smallest) one, as a sequence
    of single inserts would keep.

    An aggregate, not a window: a key repeated a million times is folded
    map-side before the shuffle.
    """
    row = F.struct(F.col("timestamp"), *[safe_int(F.col(m)).alias(m) for m in SNAPSHOT_METRICS])
    return candidates.groupBy(*KEY).agg(F.min(row).alias("r")).select(
        F.col("r.timestamp").alias("timestamp"), *KEY,
        *[F.col(f"r.{m}").alias(m) for m in SNAPSHOT_METRICS],
    )


def fresh_keys(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """One candidate per key not yet in history (left anti join on the key)."""
    return first_per_key(candidates).join(history.select(*KEY), KEY, "left_anti")


def new_rows(history: DataFrame, candidates: DataFrame,
             fresh: DataFrame | None = None, max_id: int | None = None) -> DataFrame:
    """tl_append (pure part): the rows an append would insert.

    Keys already in history are dropped (left anti join); ids continue from
    the largest stored id in (timestamp, source, fingerprint) order.  Without
    ``max_id`` the largest id is a scalar subquery over ``history``.
    """
    if fresh is None:
        fresh = fresh_keys(history, candidates)
    if max_id is None:
        max_id = history.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).scalar()
    else:
        max_id = F.lit(max_id).cast("long")
    return _snapshot(row_index(fresh, [F.col(c).asc() for c in ID_ORDER], name="pos"), max_id)


def _snapshot(numbered: DataFrame, max_id: Column) -> DataFrame:
    return numbered.select(
        (max_id + F.col("pos")).cast("long").alias("id"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        *KEY, *[F.col(m).cast("long").alias(m) for m in SNAPSHOT_METRICS],
    )


def appended(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """History after the append (history rows plus the inserted rows)."""
    cols = [f.name for f in SNAPSHOT_SCHEMA.fields]
    return history.select(*cols).unionByName(new_rows(history, candidates).select(*cols))


def append(spark: SparkSession, path: str, candidates: DataFrame) -> int:
    """tl_append: commit new snapshots to the history at ``path``.

    Returns the number of rows inserted (0 when every key was known).  The
    candidates are computed once, into a scratch table, however often a race
    makes the append begin anew.
    """
    path = path.rstrip("/")
    held = scratch_dir(spark, "snapshots")
    first_per_key(candidates).write.parquet(held)
    ready = spark.read.parquet(held)
    try:
        while True:
            version, batches = _committed(spark, path)
            history = _rows_of(spark, path, batches)
            fresh = ready.join(history.select(*KEY), KEY, "left_anti")
            inserted = fresh.count()
            if not inserted:
                return 0
            max_id = history.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).first()[0]
            if inserted <= _ONE_TASK:
                pos = F.row_number().over(Window.orderBy(*[F.col(c).asc() for c in ID_ORDER]))
                rows = _snapshot(fresh.withColumn("pos", pos), F.lit(max_id))
            else:
                rows = new_rows(history, ready, fresh, max_id)
            batch = f"batch={uuid.uuid4().hex}"
            rows.write.partitionBy("source").parquet(f"{path}/{batch}")
            if claim_next(spark, f"{path}/{_LOG}", version, batch):
                return inserted
            remove(spark, f"{path}/{batch}")
    finally:
        remove(spark, held)


# ---- read / merge / window ----------------------------------------------------

def read(history: DataFrame, source: str | None = None) -> DataFrame:
    """tl_read: snapshots by time ascending, optionally of one source, without
    id and fingerprint, the timestamp as ISO text."""
    rows = history.where(F.col("source") == source) if source else history
    return rows.orderBy(F.col("timestamp").asc(), F.col("id").asc()).select(
        iso_text("timestamp").alias("timestamp"), "source",
        *[F.col(m) for m in SNAPSHOT_METRICS],
    )


MERGED_FIELDS = {
    "dependabot": [("total", "dep_total"), ("open", "dep_open"), ("critical", "dep_critical")],
    "secrets": [("total", "sec_total"), ("open", "sec_open"), ("leaked", "sec_leaked")],
}


def merge(history: DataFrame) -> DataFrame:
    """tl_merge: one row per minute; per source the last snapshot of that
    minute wins; a source absent from a minute leaves NULLs.

    The source test sits on the *ordering* argument of ``max_by``, so rows of
    other sources never win and every snapshot (of any source) still opens
    its minute.
    """
    minute = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm")
    aggs = []
    for source, fields in MERGED_FIELDS.items():
        order = F.when(F.col("source") == source, F.struct("timestamp", "id"))
        aggs += [F.max_by(F.col(src), order).alias(dst) for src, dst in fields]
    return history.groupBy(minute.alias("timestamp")).agg(*aggs).orderBy("timestamp")


def zoom_in(left: int, right: int) -> tuple[int, int]:
    """Trim a quarter of the span from each side, keeping at least 2 points."""
    step = max(1, int((right - left) * ZOOM_IN_SHARE))
    return min(left + step, right - 1), max(right - step, left + 1)


def zoom_out(left: int, right: int, n: int) -> tuple[int, int]:
    """Widen by half the span on each side, within ``0..n-1``."""
    step = max(1, int((right - left) * ZOOM_OUT_SHARE))
    return max(0, left - step), min(n - 1, right + step)


def window(merged: DataFrame, left: int | Column, right: int | Column) -> DataFrame:
    """tl_window: merged rows at positions ``left..right`` (0-based, inclusive)."""
    pos = row_index(merged, [F.col("timestamp").asc()], name="pos", start=0)
    lo = left if isinstance(left, Column) else F.lit(left)
    hi = right if isinstance(right, Column) else F.lit(right)
    return pos.where((F.col("pos") >= lo) & (F.col("pos") <= hi)).orderBy("pos")


def zoomed_in_once(merged: DataFrame) -> DataFrame:
    """tl_window after one zoom-in from the full view, bounds as scalars."""
    n = merged.agg(F.count(F.lit(1))).scalar()
    right0 = n - 1
    step = F.greatest(F.lit(1).cast("long"), F.floor(right0 * ZOOM_IN_SHARE).cast("long"))
    left = F.least(step, right0 - 1)
    right = F.greatest(right0 - step, F.lit(1).cast("long"))
    return window(merged, left, right)


def store_path(root: str) -> str:
    return os.path.join(root, "timeline_snapshots")
