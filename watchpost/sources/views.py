"""Alert, secret, dependency and snapshot datasets derived from the driver's tables.

The driver's tables hold no security exports, so each dataset is a
projection of them (see FIXTURES.md §5).  The projections are plain joins and
``CASE`` expressions, so the datasets grow with the tables and every
operator downstream runs over whole tables.

Join strategy: no side is marked for broadcast.  Catalyst and AQE broadcast a
dimension (nation, customer, supplier, part) while it is below the size
threshold and shuffle-join it (with skew splitting) once it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nation(spark: SparkSession, sf_dir: str, keep) -> DataFrame:
    """The whole nation table; the org is NULL where ``keep`` of the key does not hold."""
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", F.when(keep(F.col("n_nationkey")), F.col("n_name")).alias("n_name")
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vulnerability alerts = orders ⋈ customer ⋈ nation.

    Nations 23 and 24 name no org, so their alerts carry a NULL org and those
    orgs exist only on the secrets side.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    nation = _nation(spark, sf_dir, lambda k: ~k.isin(23, 24))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    prio = F.col("o_orderpriority")
    tenths = key % 101
    return joined.select(
        key.alias("Alert_Number"),
        F.col("n_name").alias("Organization_Name"),
        F.col("c_name").alias("Repository_Name"),
        F.when(status == "O", "open")
        .when(status == "F", "fixed")
        .when((status == "P") & (key % 2 == 0), "dismissed")
        .when(status == "P", "auto_dismissed")
        .alias("State"),
        F.when(prio == "1-URGENT", "critical")
        .when(prio == "2-HIGH", "high")
        .when(prio == "3-MEDIUM", "medium")
        .when(prio == "5-LOW", "low")
        .alias("Severity"),
        F.col("c_mktsegment").alias("Dependency_Package_Ecosystem"),
        F.concat(
            F.lower(F.col("c_mktsegment")), F.lit("-pkg-"), (F.col("o_custkey") % 50).cast("string")
        ).alias("Dependency_Package_Name"),
        F.when(key % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("CVE-"), (key % 500).cast("string")))
        .alias("CVE_ID"),
        # Text as exported; 'n/a' marks a missing score.
        F.when(key % 13 == 0, F.lit("n/a"))
        .otherwise(
            F.concat(
                F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")
            )
        )
        .alias("CVSS_Score"),
        F.concat(prio, F.lit(" "), F.col("c_mktsegment")).alias("Advisory_Summary"),
        F.col("o_orderdate").cast("timestamp").alias("Created_At"),
    )


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret alerts = events ⟕ nation on ``user_id % 30``.

    Nations 0-2 name no org, and keys 25-29 never match, so some secrets
    have a NULL org and orgs 0-2 exist only on the alerts side.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    nation = _nation(spark, sf_dir, lambda k: k >= 3)
    joined = events.join(nation, (F.col("user_id") % 30) == F.col("n_nationkey"), "left")
    eid = F.col("event_id")
    return joined.select(
        eid.alias("Alert_Number"),
        F.col("n_name").alias("Organization_Name"),
        F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("Repository_Name"),
        F.col("event_type").alias("Secret_Type"),
        F.when(eid % 3 == 0, "open").otherwise("resolved").alias("State"),
        F.when(eid % 4 == 0, "active").when(eid % 4 == 1, "inactive").otherwise("unknown").alias(
            "Validity"
        ),
        F.when(eid % 50 == 0, "True").when(eid % 50 == 1, "TRUE").otherwise("False").alias(
            "Publicly_Leaked"
        ),
        F.when(eid % 40 == 0, F.lit("true")).alias("Push_Protection_Bypassed"),
        F.col("ts").cast("timestamp").alias("Created_At"),
    )


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency inventory = lineitem ⋈ supplier ⋈ nation ⋈ part."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    nation = _nation(spark, sf_dir, lambda k: k.isNotNull())
    # Each dimension joins the fact stream directly.  Pre-joining supplier
    # with nation would make Catalyst estimate that side as a product of the
    # two sizes and pick the fact table as the broadcast side instead.
    joined = (
        lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "inner")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "inner")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "inner")
    )
    flag = F.col("l_returnflag")
    return joined.select(
        F.col("n_name").alias("org_name"),
        F.col("s_name").alias("repo_name"),
        F.col("p_type").alias("package_name"),
        F.col("p_name").alias("dependency_name"),
        F.when(flag == "A", "true").when(flag == "R", "False").alias("is_open_source"),
    )


def snapshot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric snapshots, one per day of ``events`` per source.

    * ``secrets`` at noon + 20 s: that day's secret alerts.
    * ``dependabot`` at noon + 40 s: that day's events read as alerts
      (event type -> severity, id mod 3 -> state).
    * a second ``dependabot`` snapshot at noon + 50 s on days divisible by 5
      (same minute: the later one must win a minute bucket).
    * a repeat of the ``secrets`` key at 18:00 on days divisible by 7 with
      other numbers (a duplicate key: the first one recorded must stay).
    """
    sec = secrets(spark, sf_dir)
    day = F.to_date("Created_At")
    eid = F.col("Alert_Number")
    etype = F.col("Secret_Type")
    org = F.col("Organization_Name")
    repo = F.col("Repository_Name")
    leaked = F.col("Publicly_Leaked").isin("True", "true")
    bypassed = F.coalesce(F.col("Push_Protection_Bypassed").isin("True", "true"), F.lit(False))
    per_day = sec.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("State") == "open").alias("sec_open"),
        F.count_if(leaked).alias("sec_leaked"),
        F.count_if(bypassed).alias("sec_bypassed"),
        F.count_distinct(org).alias("n_orgs"),
        F.count_distinct(repo).alias("n_repos"),
        F.count_if(eid % 3 == 0).alias("dep_open"),
        F.count_if(eid % 3 == 1).alias("dep_fixed"),
        F.count_if(eid % 3 == 2).alias("dep_dismissed"),
        F.count_if(etype == "error").alias("dep_critical"),
        F.count_if(etype == "purchase").alias("dep_high"),
        F.count_if(etype == "click").alias("dep_medium"),
        F.count_if(etype == "view").alias("dep_low"),
    )
    noon = F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    dom = F.dayofmonth("day")
    day_txt = F.date_format("day", "yyyyMMdd")
    zero = F.lit(0).cast("long")
    c = F.col

    def snap(ts, source, fp, total, open_, critical, high, medium, low, fixed, dismissed,
             leaked_, bypassed_, orgs, repos):
        values = [total, open_, critical, high, medium, low, fixed, dismissed, leaked_,
                  bypassed_, orgs, repos]
        names = ["total", "open", "critical", "high", "medium", "low", "fixed", "dismissed",
                 "leaked", "bypassed", "orgs", "repos"]
        return F.struct(
            ts.alias("timestamp"), F.lit(source).alias("source"), fp.alias("fingerprint"),
            *[v.cast("long").alias(n) for v, n in zip(values, names)],
        )

    variants = [
        snap(noon + F.expr("INTERVAL 20 SECONDS"), "secrets", F.concat(F.lit("sec-"), day_txt),
             c("n"), c("sec_open"), zero, zero, zero, zero, zero, c("n") - c("sec_open"),
             c("sec_leaked"), c("sec_bypassed"), c("n_orgs"), c("n_repos")),
        snap(noon + F.expr("INTERVAL 40 SECONDS"), "dependabot", F.concat(F.lit("dep-"), day_txt),
             c("n"), c("dep_open"), c("dep_critical"), c("dep_high"), c("dep_medium"),
             c("dep_low"), c("dep_fixed"), c("dep_dismissed"), zero, zero, c("n_orgs"),
             c("n_repos")),
        F.when(dom % 5 == 0, snap(
            noon + F.expr("INTERVAL 50 SECONDS"), "dependabot",
            F.concat(F.lit("dep-"), day_txt, F.lit("-b")),
            c("n") - c("dep_fixed"), c("dep_open"), c("dep_critical"), c("dep_high"),
            c("dep_medium"), c("dep_low"), zero, c("dep_dismissed"), zero, zero,
            c("n_orgs"), c("n_repos"))),
        F.when(dom % 7 == 0, snap(
            c("day").cast("timestamp") + F.expr("INTERVAL 18 HOURS"), "secrets",
            F.concat(F.lit("sec-"), day_txt),
            c("n") + 1, zero, zero, zero, zero, zero, zero, zero, zero, zero, zero, zero)),
    ]
    # One aggregate; the variants fan out from its (one row per day) output.
    return (
        per_day.select(F.explode(F.array(*variants)).alias("s"))
        .where(F.col("s").isNotNull())
        .select("s.*")
    )
