"""Whole-table summary metrics (``met_*``): one row, one aggregation pass.

Conditional counts of a dataset are one ``agg`` of ``count_if`` (a map-side
partial: a few bytes of shuffle per task).  Each exact distinct count is its
own scalar subquery, ``select(c).distinct()`` then a count: the store is
columnar, so each reads just its column, de-duplicates map-side and shuffles
only distinct values.  (Several ``count(DISTINCT)`` in one ``agg`` would make
Catalyst expand every row once per distinct column instead.)  Metrics never
take filters: the reference computes them over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.functions.clean import try_double
from watchpost.functions.scalar import flag_text, is_lower_true


def _zero_if_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0, subset=columns)


def distinct_count(df: DataFrame, column: str):
    """Exact number of distinct non-null values of ``column``, as a scalar."""
    c = F.col(column)
    return df.select(c).where(c.isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()


def _with_distinct(base: DataFrame, df: DataFrame, names: dict[str, str]) -> DataFrame:
    return base.select("*", *[distinct_count(df, col).alias(n) for n, col in names.items()])


def alerts(df: DataFrame) -> DataFrame:
    """met_alerts: total, open, fixed, dismissed (+auto), severities,
    avg_cvss (2 decimals; 0 when no score, NULL when not finite),
    repos, orgs, cves."""
    state, sev = F.col("State"), F.col("Severity")
    avg = F.round(F.avg(try_double("CVSS_Score")), 2)
    out = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(state == "open").alias("open"),
        F.count_if(state == "fixed").alias("fixed"),
        F.count_if(state.isin("dismissed", "auto_dismissed")).alias("dismissed"),
        F.count_if(sev == "critical").alias("critical"),
        F.count_if(sev == "high").alias("high"),
        F.count_if(sev == "medium").alias("medium"),
        F.count_if(sev == "low").alias("low"),
        avg.alias("avg_cvss"),
    )
    out = _with_distinct(out, df, {"repos": "Repository_Name", "orgs": "Organization_Name",
                                   "cves": "CVE_ID"})
    a = F.col("avg_cvss")
    out = out.withColumn(
        "avg_cvss",
        F.when(F.isnan(a) | (F.abs(a) == F.lit(float("inf"))), F.lit(None).cast("double"))
        .otherwise(F.coalesce(a, F.lit(0.0))),
    )
    return _zero_if_null(out, ["total", "open", "fixed", "dismissed", "critical", "high",
                               "medium", "low", "repos", "orgs", "cves"])


def deps(df: DataFrame) -> DataFrame:
    """met_deps.  ``not_open_source`` uses ``LOWER(x) != 'true'``, which skips
    NULL flags (unlike the open-source breakdown)."""
    flag = is_lower_true("is_open_source")
    base = df.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(flag).alias("open_source"),
        F.count_if(~flag).alias("not_open_source"),
    )
    return _with_distinct(base, df, {
        "unique_dependencies": "dependency_name", "repos": "repo_name", "orgs": "org_name",
        "package_files": "package_name",
    })


def secrets(df: DataFrame) -> DataFrame:
    """met_secrets (keys from the reference's client; definitions ours)."""
    state, validity = F.col("State"), F.col("Validity")
    base = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(state == "open").alias("open"),
        F.count_if(state == "resolved").alias("resolved"),
        F.count_if(validity == "active").alias("active"),
        F.count_if(validity == "inactive").alias("inactive"),
        F.count_if(validity == "unknown").alias("unknown"),
        F.count_if(flag_text("Push_Protection_Bypassed")).alias("push_bypassed"),
        F.count_if(flag_text("Publicly_Leaked")).alias("publicly_leaked"),
    )
    return _with_distinct(base, df, {
        "secret_types": "Secret_Type", "repos": "Repository_Name", "orgs": "Organization_Name",
    })
