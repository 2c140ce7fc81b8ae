"""CSV export sinks (``sink_*_export``): every column of a filtered frame.

The export is a folder of part files written in parallel (one per task), not
one file funnelled through a single task.  Quotes are doubled, so the
files read back with ``watchpost.sources.csv``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from watchpost.operators import filters

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("timestampFormat", TIMESTAMP_FORMAT)
        # The writer would trim text otherwise.
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def alerts(df: DataFrame, path: str, **flt) -> str:
    """sink_alerts_export: filtered alerts (not paged, not projected)."""
    return write_csv(filters.alerts(df, **flt), path)


def deps(df: DataFrame, path: str, **flt) -> str:
    """sink_deps_export."""
    return write_csv(filters.deps(df, **flt), path)


def secrets(df: DataFrame, path: str, **flt) -> str:
    """sink_secrets_export."""
    return write_csv(filters.secrets(df, **flt), path)
