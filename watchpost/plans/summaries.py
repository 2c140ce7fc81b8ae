"""Whole-table results computed once per ingested file.

Metrics, chart breakdowns and filter options never depend on request filters
(the reference computes them over the whole table), so for a given store
fingerprint they are fixed.  Computing them once at ingest and serving every
request from the small result tables turns a full scan of a very large store
per page view into a read of a few kilobytes.  Results live next to the
store under ``<root>/<dataset>/summaries/fingerprint=<id>/<name>`` and are
only (re)built when missing, like the store itself.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpost.operators import breakdowns as bd
from watchpost.operators import metrics as met
from watchpost.operators import options as opt
from watchpost.operators import overview as ovw
from watchpost.schema import ALERTS, DEPS, SECRETS
from watchpost.session import finished

Build = Callable[[DataFrame], DataFrame]


def distinct_values(column: str, alias: str) -> Build:
    """Distinct non-null values of a column: what typeahead searches."""
    def run(df: DataFrame) -> DataFrame:
        c = F.col(column)
        return df.where(c.isNotNull()).select(c.alias(alias)).distinct()
    return run


SUMMARIES: dict[str, dict[str, Build]] = {
    "alerts": {
        "metrics": met.alerts,
        "options": opt.alerts,
        "severity": bd.alert_severity,
        "state": bd.alert_state,
        "ecosystem": bd.alert_ecosystem,
        "org": bd.alert_org,
        "trend": bd.alert_trend,
        "orgs": distinct_values(ALERTS.org, "org"),
    },
    "secrets": {
        "metrics": met.secrets,
        "options": opt.secrets,
        "secret_type": bd.secret_type,
        "state": bd.secret_state,
        "validity": bd.secret_validity,
        "org": bd.secret_org,
        "trend": bd.secret_trend,
        "orgs": distinct_values(SECRETS.org, "org"),
    },
    "deps": {
        "metrics": met.deps,
        "options": opt.deps,
        "package_file": bd.deps_manifest,
        "org": bd.deps_org,
        "repo": bd.deps_repo,
        "top_dependencies": bd.deps_top,
        "open_source": bd.deps_open_source,
        "orgs": distinct_values(DEPS.org, "org"),
        "repos": distinct_values(DEPS.repo, "repo"),
    },
}


def location(root: str, dataset: str, fingerprint: str, name: str) -> str:
    return f"{root.rstrip('/')}/{dataset}/summaries/fingerprint={fingerprint}/{name}"


def present(spark: SparkSession, path: str) -> bool:
    """Whether a finished summary exists: one whose job has committed."""
    return finished(spark, path)


def build(spark: SparkSession, df: DataFrame, root: str, dataset: str, fingerprint: str,
          threads: int = 8) -> list[str]:
    """Compute every summary of ``dataset`` that is missing; return the names built.

    Each result is a grouped or one-row frame, written as it comes out of its
    final aggregate (no single-task step is added).  The jobs are submitted
    from ``threads`` driver threads at once; under the FAIR scheduler they
    share the executors instead of running one after another.
    """
    todo = [
        (name, fn) for name, fn in SUMMARIES[dataset].items()
        if not present(spark, location(root, dataset, fingerprint, name))
    ]

    def one(item):
        name, fn = item
        fn(df).write.mode("overwrite").parquet(location(root, dataset, fingerprint, name))
        return name

    if threads <= 1 or len(todo) <= 1:
        return [one(item) for item in todo]
    with ThreadPoolExecutor(max_workers=min(threads, len(todo))) as pool:
        return list(pool.map(one, todo))


def read(spark: SparkSession, root: str, dataset: str, fingerprint: str, name: str) -> DataFrame:
    """A stored summary, ordered like the live operator's output.

    A summary is a result table (a top-k, one row per day or per option
    value), so it is ordered inside one partition: no range-partitioning
    sample job for a few rows.
    """
    df = spark.read.parquet(location(root, dataset, fingerprint, name))
    cols = df.columns
    keys = [df[c].asc_nulls_last() for c, t in df.dtypes if t == "string"]
    one = df.coalesce(1)
    if "date" in cols:
        return one.sortWithinPartitions("date")
    if "option" in cols:
        return one.sortWithinPartitions("option", "value")
    for measure in ("count", "total", "total_deps", "repo_count"):
        if measure in cols:
            return one.sortWithinPartitions(df[measure].desc(), *keys)
    return df


def overview_location(root: str, alerts_fp: str | None, secrets_fp: str | None) -> str:
    return f"{root.rstrip('/')}/overview/alerts={alerts_fp or 'none'}/secrets={secrets_fp or 'none'}"


def build_overview(spark: SparkSession, alerts: DataFrame | None, secrets: DataFrame | None,
                   root: str, alerts_fp: str | None, secrets_fp: str | None) -> bool:
    """The org board and the totals for one pair of store versions."""
    path = overview_location(root, alerts_fp, secrets_fp)
    if present(spark, f"{path}/board") and present(spark, f"{path}/totals"):
        return False
    ovw.orgs(alerts, secrets).write.mode("overwrite").parquet(f"{path}/board")
    ovw.totals(alerts, secrets).write.mode("overwrite").parquet(f"{path}/totals")
    return True


def read_overview(spark: SparkSession, root: str, alerts_fp: str | None,
                  secrets_fp: str | None, name: str) -> DataFrame:
    df = spark.read.parquet(f"{overview_location(root, alerts_fp, secrets_fp)}/{name}")
    if name == "board":
        return df.orderBy(F.col("total_vulns").desc(), F.col("org").asc())
    return df
