"""Grouped breakdowns (``agg_*``): counts per key, top-k, daily trend, shares.

Each breakdown is a hash aggregate with a map-side partial, so a key that
holds a third of all rows costs one partial row per task, not a hot
reducer.  ``COUNT(DISTINCT x)`` per group is rewritten by Catalyst into a
two-level aggregate keyed by ``(group, x)`` first, which spreads a hot group
over many reducers.  Top-k is ``orderBy(...).limit(k)``, planned as
``TakeOrderedAndProject`` over the (small) grouped frame.  NULL keys form
their own group; ties at the k-th place are broken by the key ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpost.functions.scalar import os_category
from watchpost.schema import (
    TOP_DEPENDENCIES,
    TOP_ECOSYSTEMS,
    TOP_MANIFESTS,
    TOP_ORGS,
    TOP_REPOS,
)


def count_by(df: DataFrame, key: str | Column, name: str, k: int | None = None,
             metrics: list[Column] | None = None, order_by: str = "count",
             extra_keys: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows per ``key`` (aliased ``name``), descending by ``order_by``.

    ``metrics`` replaces the default ``count`` column; ``extra_keys`` adds
    further grouping columns as ``(column, alias)`` pairs.
    """
    keycol = F.col(key) if isinstance(key, str) else key
    groups = [keycol.alias(name)] + [F.col(c).alias(a) for c, a in (extra_keys or [])]
    aggs = metrics or [F.count(F.lit(1)).alias("count")]
    out = df.groupBy(*groups).agg(*aggs)
    order = [F.col(order_by).desc(), F.col(name).asc_nulls_last()]
    order += [F.col(a).asc_nulls_last() for _, a in (extra_keys or [])]
    out = out.orderBy(*order)
    return out.limit(k) if k else out


def trend(df: DataFrame, column: str) -> DataFrame:
    """Rows per calendar day (UTC) of ``column``; NULL dates excluded; the day
    is ISO text, ascending."""
    day = F.to_date(F.col(column))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(day.alias("day"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("day").cast("string").alias("date"), F.col("count"))
        .orderBy("date")
    )


def share(grouped: DataFrame, count_col: str = "count") -> DataFrame:
    """agg_share: each slice's share of the total and its whole percent.

    The total is a scalar subquery over the grouped frame, so the slices
    stay distributed (no single-partition window).
    """
    total = grouped.agg(F.sum(F.col(count_col))).scalar()
    frac = F.col(count_col) / total
    return grouped.withColumn("share", frac).withColumn(
        "percent", F.round(F.col("share") * 100, 0).cast("long")
    )


# ---- alerts ---------------------------------------------------------------

def alert_severity(df: DataFrame) -> DataFrame:
    return count_by(df, "Severity", "Severity")


def alert_state(df: DataFrame) -> DataFrame:
    return count_by(df, "State", "State")


def alert_ecosystem(df: DataFrame) -> DataFrame:
    return count_by(df, "Dependency_Package_Ecosystem", "ecosystem", k=TOP_ECOSYSTEMS)


def _org_metrics(total_name: str = "total") -> list[Column]:
    return [
        F.count(F.lit(1)).alias(total_name),
        F.count_if(F.col("State") == "open").alias("open"),
        F.count_distinct("Repository_Name").alias("repos"),
    ]


def alert_org(df: DataFrame) -> DataFrame:
    """agg_alert_org: top 20 orgs by alerts, with open and distinct repos."""
    return count_by(df, "Organization_Name", "org", k=TOP_ORGS, metrics=_org_metrics(),
                    order_by="total")


def alert_trend(df: DataFrame) -> DataFrame:
    return trend(df, "Created_At")


# ---- secrets (top-k sizes follow the alert charts) ------------------------

def secret_type(df: DataFrame) -> DataFrame:
    return count_by(df, "Secret_Type", "Secret_Type")


def secret_state(df: DataFrame) -> DataFrame:
    return count_by(df, "State", "State")


def secret_validity(df: DataFrame) -> DataFrame:
    return count_by(df, "Validity", "Validity")


def secret_org(df: DataFrame) -> DataFrame:
    return count_by(df, "Organization_Name", "org", k=TOP_ORGS, metrics=_org_metrics(),
                    order_by="total")


def secret_trend(df: DataFrame) -> DataFrame:
    return trend(df, "Created_At")


# ---- dependencies ---------------------------------------------------------

def deps_manifest(df: DataFrame) -> DataFrame:
    return count_by(df, "package_name", "package_file", k=TOP_MANIFESTS)


def deps_org(df: DataFrame) -> DataFrame:
    return count_by(
        df, "org_name", "org", k=TOP_ORGS, order_by="total_deps",
        metrics=[
            F.count(F.lit(1)).alias("total_deps"),
            F.count_distinct("dependency_name").alias("unique_deps"),
            F.count_distinct("repo_name").alias("repos"),
        ],
    )


def deps_repo(df: DataFrame) -> DataFrame:
    """Top 20 (repo, org) pairs."""
    return count_by(
        df, "repo_name", "repo", k=TOP_REPOS, order_by="total_deps", extra_keys=[("org_name", "org")],
        metrics=[
            F.count(F.lit(1)).alias("total_deps"),
            F.count_distinct("dependency_name").alias("unique_deps"),
        ],
    )


def deps_top(df: DataFrame) -> DataFrame:
    """Top 20 dependencies.  ``repo_count`` is the row count (the reference's
    naming), ``repos`` the distinct repositories."""
    return count_by(
        df, "dependency_name", "dependency", k=TOP_DEPENDENCIES, order_by="repo_count",
        metrics=[
            F.count(F.lit(1)).alias("repo_count"),
            F.count_distinct("repo_name").alias("repos"),
        ],
    )


def deps_open_source(df: DataFrame) -> DataFrame:
    """Open source vs not; NULL flags count as not open source here."""
    return count_by(df, os_category("is_open_source"), "category")
