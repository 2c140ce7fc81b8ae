"""Cross-dataset overview (``ovw_*``): per-org rollups of alerts and secrets,
their full outer join, totals, risk level, heat and rank.

Plan shape: each side is one partial+final hash aggregate keyed by org (a hot
org costs one partial row per task).  Both aggregates leave their output
hash-partitioned by org, so the full outer join on org is a sort-merge join
that needs no further shuffle.  Scalars over the org board (the largest
total) are scalar subqueries - one value computed once and inlined - and the
rank is a distributed ``row_index``; no step sends the board to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpost.functions.ordering import row_index
from watchpost.functions.scalar import flag_text
from watchpost.schema import (
    HEAT_BASE,
    HEAT_CELLS,
    HEAT_FLAT,
    HEAT_SPAN,
    RISK_LABELS,
    RISK_MEDIUM_SHARE,
)

def org_alerts(alerts: DataFrame) -> DataFrame:
    """ovw_org_alerts: per non-null org: total, open, critical, high, repos."""
    state, sev = F.col("State"), F.col("Severity")
    return (
        alerts.where(F.col("Organization_Name").isNotNull())
        .groupBy(F.col("Organization_Name").alias("org"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(state == "open").alias("open"),
            F.count_if(sev == "critical").alias("critical"),
            F.count_if(sev == "high").alias("high"),
            F.count_distinct("Repository_Name").alias("repos"),
        )
    )


def org_secrets(secrets: DataFrame) -> DataFrame:
    """ovw_org_secrets: per non-null org: total, open, leaked, bypassed, repos."""
    return (
        secrets.where(F.col("Organization_Name").isNotNull())
        .groupBy(F.col("Organization_Name").alias("org"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("State") == "open").alias("open"),
            F.count_if(flag_text("Publicly_Leaked")).alias("leaked"),
            F.count_if(flag_text("Push_Protection_Bypassed")).alias("bypassed"),
            F.count_distinct("Repository_Name").alias("repos"),
        )
    )


def orgs(alerts: DataFrame | None, secrets: DataFrame | None) -> DataFrame:
    """ovw_orgs: full outer join of both rollups on org; absent counts are 0.

    ``repos`` is the larger of the two repo counts (not a union), as in the
    reference.  Ordered by total_vulns descending, then org.
    """
    if alerts is None and secrets is None:
        raise ValueError("at least one dataset is required")
    spark = (alerts if alerts is not None else secrets).sparkSession
    if alerts is not None:
        dep = org_alerts(alerts)
    else:
        dep = spark.createDataFrame([], "org string, total long, open long, critical long, "
                                        "high long, repos long")
    if secrets is not None:
        sec = org_secrets(secrets)
    else:
        sec = spark.createDataFrame([], "org string, total long, open long, leaked long, "
                                        "bypassed long, repos long")
    dep = dep.select(
        "org",
        *[F.col(c).alias(f"dep_{c}") for c in ["total", "open", "critical", "high", "repos"]],
    )
    sec = sec.select(
        "org",
        *[F.col(c).alias(f"sec_{c}") for c in ["total", "open", "leaked", "bypassed", "repos"]],
    )
    counts = [c for c in dep.columns + sec.columns if c != "org"]
    board = dep.join(sec, "org", "full_outer").fillna(0, subset=counts)
    return board.select(
        "org", "dep_total", "dep_open", "dep_critical", "dep_high",
        "sec_total", "sec_open", "sec_leaked", "sec_bypassed",
        (F.col("dep_total") + F.col("sec_total")).alias("total_vulns"),
        (F.col("dep_open") + F.col("sec_open")).alias("total_open"),
        F.greatest("dep_repos", "sec_repos").alias("repos"),
    ).orderBy(F.col("total_vulns").desc(), F.col("org").asc())


def totals(alerts: DataFrame | None, secrets: DataFrame | None) -> DataFrame:
    """ovw_totals: one row of landing-page totals; a missing source counts 0.

    Both datasets are projected to the same few columns and unioned, so the
    totals and the org count (distinct non-null orgs of either side, which is
    the number of overview rows) come from a single aggregation.
    """
    parts = []
    if alerts is not None:
        parts.append(alerts.select(
            F.lit(True).alias("is_dep"),
            (F.col("State") == "open").alias("is_open"),
            (F.col("Severity") == "critical").alias("is_critical"),
            F.lit(False).alias("is_leaked"),
            F.col("Organization_Name").alias("org"),
        ))
    if secrets is not None:
        parts.append(secrets.select(
            F.lit(False).alias("is_dep"),
            (F.col("State") == "open").alias("is_open"),
            F.lit(False).alias("is_critical"),
            flag_text("Publicly_Leaked").alias("is_leaked"),
            F.col("Organization_Name").alias("org"),
        ))
    if not parts:
        raise ValueError("at least one dataset is required")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    dep, opn = F.col("is_dep"), F.col("is_open")
    agg = rows.agg(
        F.count_if(dep).alias("dep_total"),
        F.count_if(dep & opn).alias("dep_open"),
        F.count_if(~dep).alias("sec_total"),
        F.count_if(~dep & opn).alias("sec_open"),
        F.count_if(F.col("is_critical")).alias("critical"),
        F.count_if(F.col("is_leaked")).alias("leaked"),
        F.count_distinct("org").alias("orgs"),
    )
    tv = F.col("dep_total") + F.col("sec_total")
    to = F.col("dep_open") + F.col("sec_open")
    return agg.select(
        tv.alias("total_vulns"),
        to.alias("total_open"),
        F.when(tv > 0, F.round(to / tv * 100, 1)).otherwise(F.lit(0.0)).alias("open_pct"),
        "dep_total", "dep_open", "critical", "sec_total", "sec_open", "leaked", "orgs",
    )


def _max_total(board: DataFrame) -> Column:
    """Largest total_vulns (0 when there are no orgs) as a scalar subquery."""
    return board.agg(F.coalesce(F.max("total_vulns"), F.lit(0).cast("long"))).scalar()


def risk_label(max_total: Column) -> Column:
    """ovw_risk rules, in order."""
    c = F.col
    critical, high, none, medium, low = RISK_LABELS
    ratio = F.when(max_total > 0, c("total_open") / max_total).otherwise(F.lit(0.0))
    return (
        F.when((c("dep_critical") > 0) | (c("sec_leaked") > 0), F.lit(critical))
        .when((c("dep_high") > 0) | (c("sec_bypassed") > 0), F.lit(high))
        .when((c("total_open") == 0) & (c("total_vulns") == 0), F.lit(none))
        .when(ratio >= RISK_MEDIUM_SHARE, F.lit(medium))
        .otherwise(F.lit(low))
    )


def risk(board: DataFrame) -> DataFrame:
    """ovw_risk: the board plus each org's risk level."""
    return board.withColumn("risk", risk_label(_max_total(board)))


def _ranked(board: DataFrame) -> DataFrame:
    order = [F.col("total_vulns").desc(), F.col("org").asc()]
    return row_index(board, order, name="rank")


def heat(board: DataFrame, cells: int = HEAT_CELLS) -> DataFrame:
    """ovw_heat: intensity of the first ``cells`` orgs.

    ``0.25 + min(total/max, 1) * 0.65``; a flat 0.5 when the max is 0 or the
    risk is None.
    """
    top = board.orderBy(F.col("total_vulns").desc(), F.col("org").asc()).limit(cells)
    # The first cell holds the largest total, so the few cells are enough.
    mx = F.coalesce(F.max("total_vulns").over(Window.partitionBy()), F.lit(0).cast("long"))
    top = top.withColumn("mx", mx)
    mx = F.col("mx")
    top = top.withColumn("risk", risk_label(mx))
    t = F.least(F.col("total_vulns") / mx, F.lit(1.0))
    none_label = RISK_LABELS[2]
    intensity = F.when((mx == 0) | (F.col("risk") == none_label), F.lit(HEAT_FLAT)).otherwise(
        F.lit(HEAT_BASE) + t * F.lit(HEAT_SPAN)
    )
    return top.select("org", "total_vulns", "risk", intensity.alias("intensity"))


def rank(board: DataFrame) -> DataFrame:
    """ovw_rank: 1-based position in overview order and bar width in percent."""
    # The ranks are numbered from a checkpoint; the largest total is read from it too.
    ranked = _ranked(board)
    mx = _max_total(ranked)
    bar = F.when(mx > 0, F.col("total_vulns") / mx * 100).otherwise(F.lit(0.0))
    return ranked.select("rank", "org", "total_vulns", bar.alias("bar")).orderBy("rank")
