"""Fingerprinted Parquet store (``src_fingerprint``, ``sink_store``).

A CSV export is parsed once into Parquet under
``<root>/<dataset>/fingerprint=<id>/`` and reused while the file is
unchanged.  The id hashes each file's name, size and modification time, not
its content.  Stores are per dataset and old ones are never deleted by an
ingest of another dataset.

Each parse is a version, a folder of its own.  When its files are written, a
manifest beside them gets every file's name, size, number of rows and a hash
of its rows, and only then a log entry publishes the version; the last entry
counts.  A reuse checks names, sizes and row counts (of the files' footers),
with ``verify="rows"`` all rows too.  A version that fails is left to its
readers and the store is made anew as the next version.
"""

from __future__ import annotations

import json
import logging
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from watchpost.operators import metrics as met
from watchpost.operators import timeline as tl
from watchpost.schema import ALERTS, DEPS, SECRETS
from watchpost.session import claim_next, finished, log_entries, log_entry
from watchpost.sources import csv as src

log = logging.getLogger(__name__)

_READERS = {"alerts": src.alerts, "secrets": src.secrets, "deps": src.deps}
_ORG = {"alerts": ALERTS.org, "secrets": SECRETS.org, "deps": DEPS.org}
_SNAPSHOT_SOURCE = {"alerts": "dependabot", "secrets": "secrets"}
_METRICS = {"alerts": met.alerts, "secrets": met.secrets}


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Per data file: name, size, modification time and its 12-hex id
    ``md5(name-size-mtime_ns)``.  Only file metadata is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    mtime_ns = (F.unix_micros(F.col("modificationTime")) * 1000).cast("string")
    fp = F.substring(F.md5(F.concat_ws("-", name, F.col("length").cast("string"), mtime_ns)), 1, 12)
    return files.select(
        name.alias("file_name"), F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"), fp.alias("fingerprint"),
    )


def fingerprint_frame(spark: SparkSession, path: str) -> DataFrame:
    """src_fingerprint: one row holding the dataset id.  A single file keeps
    its own id; a folder of part files combines its files' ids with an
    order-independent XOR of their 64-bit hashes, an aggregate with a
    map-side partial, so no list of files is gathered in one task."""
    per_file = file_fingerprints(spark, path)
    entry = F.concat_ws(":", "file_name", "fingerprint")
    combined = per_file.agg(
        F.count(F.lit(1)).alias("files"),
        F.min("fingerprint").alias("_one"),
        F.bit_xor(F.xxhash64(entry)).alias("_mix"),
    )
    return combined.select(
        "files",
        F.when(F.col("files") == 1, F.col("_one"))
        .otherwise(F.substring(F.md5(F.concat_ws("-", F.col("files").cast("string"),
                                                 F.col("_mix").cast("string"))), 1, 12))
        .alias("fingerprint"),
    )


def fingerprint(spark: SparkSession, path: str) -> str:
    return fingerprint_frame(spark, path).first()["fingerprint"]


def write_sorted(df: DataFrame, path: str, org: str | None) -> None:
    """Store layout: files as the reader's splits give them, each sorted by
    org (min/max pruning).  No shuffle, and not range-partitioned by org: one
    org may hold a third of all rows."""
    if org and org in df.columns:
        df = df.sortWithinPartitions(F.col(org).asc_nulls_last())
    df.write.mode("overwrite").parquet(path)


def _counted(spark: SparkSession, path: str, schema: StructType, rows: bool) -> DataFrame:
    """Per Parquet file of a folder: name, number of rows, and with ``rows`` a hash of them; unreadable files count less."""
    reader = spark.read.schema(schema if rows else "none int").option("ignoreCorruptFiles", True)
    found = reader.parquet(path)
    mix = F.bit_xor(F.xxhash64(*found.columns)) if rows else F.lit(None).cast("long")
    return found.groupBy(F.col("_metadata.file_name").alias("name")).agg(
        F.count(F.lit(1)).alias("rows"), mix.alias("mix"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"))


def publish(spark: SparkSession, parsed: DataFrame, base: str, org: str | None) -> str:
    """Write a frame as a new version of the store at ``base``, and make it the current one."""
    version = f"version={uuid.uuid4().hex}"
    path = f"{base}/{version}"
    write_sorted(parsed, path, org)
    schema = spark.read.parquet(path).schema
    # Files without rows are in the list only.
    manifest = _listed(spark, path).join(_counted(spark, path, schema, True), "name", "left")
    manifest.write.parquet(f"{path}/_manifest")
    entry = json.dumps({"version": version, "schema": schema.json()})
    numbers = log_entries(spark, f"{base}/_log")
    while not claim_next(spark, f"{base}/_log", numbers[-1] if numbers else 0, entry):
        numbers = log_entries(spark, f"{base}/_log")
    return path


def current(spark: SparkSession, base: str) -> tuple[str, StructType] | None:
    """The folder and schema of the version published last; None if there is none."""
    numbers = log_entries(spark, f"{base}/_log")
    if not numbers:
        return None
    entry = json.loads(log_entry(spark, f"{base}/_log", numbers[-1]))
    return f"{base}/{entry['version']}", StructType.fromJson(json.loads(entry["schema"]))


def whole(spark: SparkSession, path: str, schema: StructType, verify: str = "footers") -> bool:
    """Whether a version's files are those of its manifest."""
    if verify not in ("footers", "rows"):
        raise ValueError("verify is 'footers' or 'rows'")
    if not finished(spark, f"{path}/_manifest"):
        return False
    rows = verify == "rows"
    want = spark.read.schema("name string, size long, rows long, mix long").parquet(f"{path}/_manifest")
    have = _listed(spark, path).join(_counted(spark, path, schema, rows), "name", "left")
    have = have.select("name", *[F.col(c).alias(f"have_{c}") for c in ("size", "rows", "mix")])
    same = F.col("size").eqNullSafe(F.col("have_size")) & F.col("rows").eqNullSafe(F.col("have_rows"))
    if rows:
        same &= F.col("mix").eqNullSafe(F.col("have_mix"))
    try:
        return want.join(have, "name", "full_outer").where(~same).isEmpty()
    except (PySparkException, Py4JJavaError) as error:
        log.warning("store at %s cannot be read: %s", path, error)
        return False


def store(spark: SparkSession, csv_path: str, root: str, dataset: str, record_snapshot: bool = True,
          summaries: bool = False, verify: str = "footers") -> DataFrame:
    """sink_store: the parsed dataset, from the store when its id matches and its files are whole.

    A fresh parse is written sorted inside each file by org, so Parquet
    min/max statistics let org filters skip row groups (``write_sorted``).  For alerts and
    secrets a metric snapshot is appended to the timeline on every ingest,
    reused store or not (duplicates are skipped by key).  With
    ``summaries`` the filter-independent results (metrics, charts, options)
    are computed once for this fingerprint (``plans.summaries``).
    """
    fp = fingerprint(spark, csv_path)
    base = f"{root.rstrip('/')}/{dataset}/fingerprint={fp}"
    found = current(spark, base)
    if found is None or not whole(spark, *found, verify):
        publish(spark, _READERS[dataset](spark, csv_path), base, _ORG[dataset])
        found = current(spark, base)
    df = spark.read.schema(found[1]).parquet(found[0])
    if summaries:
        from watchpost.plans import summaries as summ

        summ.build(spark, df, root, dataset, fp)
    if record_snapshot and dataset in _SNAPSHOT_SOURCE:
        try:
            cand = tl.from_metrics(_METRICS[dataset](df), _SNAPSHOT_SOURCE[dataset], fp)
            tl.append(spark, tl.store_path(root), cand)
        except Exception:  # noqa: BLE001 - history is best effort, never blocks ingest
            log.exception("no snapshot was recorded for %s", fp)
    return df
