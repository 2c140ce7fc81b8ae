"""SparkSession construction and shared-storage settings.

The library never builds a session behind the caller's back when one is
already active; ``get_session`` only fills in settings that are unset, so a
cluster's own configuration (shuffle partitions, checkpoint folder, memory)
always wins.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Settings every operator relies on.  Only applied when the key is unset.
_DEFAULTS = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, switch joins to broadcast when a side turns out small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Snapshots are stamped in UTC; day buckets and ISO text must not drift.
    "spark.sql.session.timeZone": "UTC",
    # CSV: with pruning on, DROPMALFORMED decides per projected column set,
    # so count() and collect() disagree.  Off keeps one answer.
    "spark.sql.csv.parser.columnPruning.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Interactive requests share the cluster instead of queueing behind a
    # long export or ingest job.
    "spark.scheduler.mode": "FAIR",
}


def get_session(master: str | None = None, app_name: str = "watchpost",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build one with the library defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator and must be shared
    storage; it is only read here, and its absence raises.  With a local master
    (tests) a temporary folder is created when the setting is absent.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        conf_dir = sc.getCheckpointDir()
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="watchpost-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for materialised tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def _hadoop_path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared checkpoint folder, deleted when the session's JVM ends."""
    path = shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
    at, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(at)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; any other storage error is raised."""
    at, fs = _hadoop_path(spark, path)
    return bool(fs.exists(at))


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job has committed its output folder (its ``_SUCCESS`` is there)."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def part_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a file or folder path, sorted; an absent path has none."""
    at, fs = _hadoop_path(spark, path)
    found = fs.globStatus(at)
    if found is None:
        return []
    out = []
    for status in found:
        entries = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [
            e.getPath().toString() for e in entries
            if e.isFile() and not e.getPath().getName().startswith(("_", "."))
        ]
    return sorted(out)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder this checkout lies in.

    A cluster whose executors do not see that folder needs the package
    installed or passed with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    at, fs = _hadoop_path(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted; nothing if it is absent."""
    at, fs = _hadoop_path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, with all it holds."""
    at, fs = _hadoop_path(spark, path)
    fs.delete(at, True)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content unless it is there already; whether this call made it.

    The content is written under another name first, then given the file's
    name by an operation that fails where that name is taken: a hard link on
    local file systems, a rename on HDFS and the like.
    """
    at, fs = _hadoop_path(spark, path)
    fs.mkdirs(at.getParent())
    draft, _ = _hadoop_path(spark, f"{os.path.dirname(path)}/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    try:
        if fs.getUri().getScheme() != "file":
            return not fs.exists(at) and bool(fs.rename(draft, at))
        jvm = spark.sparkContext._jvm
        here, there = (jvm.java.io.File(p.toUri().getPath()).toPath() for p in (draft, at))
        try:
            jvm.java.nio.file.Files.createLink(there, here)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)


def claim_next(spark: SparkSession, folder: str, after: int, text: str) -> bool:
    """Claim the log entry that follows number ``after``."""
    return claim(spark, f"{folder.rstrip('/')}/{after + 1:012d}", text)


def log_entries(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of all entries of a log, ascending."""
    return [int(n) for n in names(spark, folder) if n.isdigit()]


def log_entry(spark: SparkSession, folder: str, number: int) -> str:
    return read_small(spark, f"{folder.rstrip('/')}/{number:012d}")
