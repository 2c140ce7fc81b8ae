"""Distinct filter options (``opt_*``) and typeahead (``ta_*``).

Both are a partial/final hash aggregate on the value (map-side dedup, then a
shuffle of distinct values only) followed by a top-k sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.operators.filters import like_escape
from watchpost.schema import TYPEAHEAD_DEFAULT, TYPEAHEAD_MAX


def distinct_options(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """Sorted distinct non-null values of several columns in one pass.

    Output is a long frame ``(option, value)``: each row is unpivoted into
    one row per option with ``stack``, so all lists share one scan and one
    aggregation.
    """
    pairs = ", ".join(f"'{name}', CAST(`{col}` AS STRING)" for name, col in options.items())
    long = df.select(F.expr(f"stack({len(options)}, {pairs}) AS (option, value)"))
    return (
        long.where(F.col("value").isNotNull())
        .distinct()
        .orderBy(F.col("option").asc(), F.col("value").asc())
    )


def alerts(df: DataFrame) -> DataFrame:
    """opt_alerts."""
    return distinct_options(
        df, {"severities": "Severity", "states": "State", "ecosystems": "Dependency_Package_Ecosystem"}
    )


def deps(df: DataFrame) -> DataFrame:
    """opt_deps."""
    return distinct_options(df, {"package_files": "package_name", "is_open_source": "is_open_source"})


def secrets(df: DataFrame) -> DataFrame:
    """opt_secrets (lists are a design choice: types, states, validities)."""
    return distinct_options(
        df, {"secret_types": "Secret_Type", "states": "State", "validities": "Validity"}
    )


def typeahead(df: DataFrame, column: str, q: str = "", limit: int = TYPEAHEAD_DEFAULT,
              alias: str | None = None) -> DataFrame:
    """Distinct non-null values containing ``q`` (case-insensitive), sorted,
    at most ``limit``.  A blank ``q`` returns the first ``limit`` values.

    Blankness is judged on ``q.strip()`` but the pattern uses ``q`` as given.
    """
    if not 1 <= limit <= TYPEAHEAD_MAX:
        raise ValueError(f"limit must be within 1..{TYPEAHEAD_MAX}")
    c = F.col(column)
    cond = c.isNotNull()
    if q.strip():
        cond = cond & c.ilike("%" + like_escape(q) + "%")
    name = alias or column
    return df.where(cond).select(c.alias(name)).distinct().orderBy(F.col(name).asc()).limit(limit)
