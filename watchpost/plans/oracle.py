"""DuckDB statements equal to each registered query (the correctness oracle).

Every statement starts from the driver's raw tables (pre-registered views
``orders customer nation events lineitem supplier part``) and rebuilds the
same derived datasets as ``watchpost.sources.views`` with CTEs.  Tie-breaks
and NULL placement are spelled out exactly as in the Spark plans.
"""

from __future__ import annotations

# ---- derived datasets --------------------------------------------------------

ALERTS = """alerts AS (
  SELECT o.o_orderkey AS Alert_Number,
         CASE WHEN n.n_nationkey NOT IN (23, 24) THEN n.n_name END AS Organization_Name,
         c.c_name AS Repository_Name,
         CASE WHEN o.o_orderstatus = 'O' THEN 'open'
              WHEN o.o_orderstatus = 'F' THEN 'fixed'
              WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 2 = 0 THEN 'dismissed'
              WHEN o.o_orderstatus = 'P' THEN 'auto_dismissed' END AS State,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'critical'
              WHEN o.o_orderpriority = '2-HIGH' THEN 'high'
              WHEN o.o_orderpriority = '3-MEDIUM' THEN 'medium'
              WHEN o.o_orderpriority = '5-LOW' THEN 'low' END AS Severity,
         c.c_mktsegment AS Dependency_Package_Ecosystem,
         lower(c.c_mktsegment) || '-pkg-' || CAST(o.o_custkey % 50 AS VARCHAR)
           AS Dependency_Package_Name,
         CASE WHEN o.o_orderkey % 7 = 0 THEN NULL
              ELSE 'CVE-' || CAST(o.o_orderkey % 500 AS VARCHAR) END AS CVE_ID,
         CASE WHEN o.o_orderkey % 13 = 0 THEN 'n/a'
              ELSE CAST((o.o_orderkey % 101) // 10 AS VARCHAR) || '.'
                   || CAST((o.o_orderkey % 101) % 10 AS VARCHAR) END AS CVSS_Score,
         o.o_orderpriority || ' ' || c.c_mktsegment AS Advisory_Summary,
         CAST(o.o_orderdate AS TIMESTAMP) AS Created_At
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

SECRETS = """secrets AS (
  SELECT e.event_id AS Alert_Number,
         CASE WHEN n.n_nationkey >= 3 THEN n.n_name END AS Organization_Name,
         'repo-' || CAST(e.user_id AS VARCHAR) AS Repository_Name,
         e.event_type AS Secret_Type,
         CASE WHEN e.event_id % 3 = 0 THEN 'open' ELSE 'resolved' END AS State,
         CASE WHEN e.event_id % 4 = 0 THEN 'active'
              WHEN e.event_id % 4 = 1 THEN 'inactive' ELSE 'unknown' END AS Validity,
         CASE WHEN e.event_id % 50 = 0 THEN 'True'
              WHEN e.event_id % 50 = 1 THEN 'TRUE' ELSE 'False' END AS Publicly_Leaked,
         CASE WHEN e.event_id % 40 = 0 THEN 'true' END AS Push_Protection_Bypassed,
         CAST(e.ts AS TIMESTAMP) AS Created_At
  FROM events e
  LEFT JOIN nation n ON e.user_id % 30 = n.n_nationkey
)"""

DEPS = """deps AS (
  SELECT n.n_name AS org_name,
         s.s_name AS repo_name,
         p.p_type AS package_name,
         p.p_name AS dependency_name,
         CASE WHEN l.l_returnflag = 'A' THEN 'true'
              WHEN l.l_returnflag = 'R' THEN 'False' END AS is_open_source
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def iso(expr: str) -> str:
    """Timestamp as ISO text, fraction only when non-zero (see clean.iso_text)."""
    return (
        f"CASE WHEN {expr} IS NULL THEN NULL "
        f"WHEN microsecond({expr}) % 1000000 = 0 THEN strftime({expr}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def finite(expr: str) -> str:
    return f"CASE WHEN isnan({expr}) OR isinf({expr}) THEN NULL ELSE {expr} END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ALERT_COLS = (
    "Alert_Number, Organization_Name, Repository_Name, State, Severity, "
    "Dependency_Package_Ecosystem, Dependency_Package_Name, CVE_ID, CVSS_Score, "
    f"Advisory_Summary, {iso('Created_At')} AS Created_At"
)
SECRET_COLS = (
    "Alert_Number, Organization_Name, Repository_Name, Secret_Type, State, Validity, "
    f"Publicly_Leaked, Push_Protection_Bypassed, {iso('Created_At')} AS Created_At"
)
DEPS_COLS = "org_name, repo_name, package_name, dependency_name, is_open_source"

SNAPSHOT_METRICS = (
    "total, open, critical, high, medium, low, fixed, dismissed, leaked, bypassed, orgs, repos"
)


def like(q: str) -> str:
    """DuckDB ILIKE pattern literal for user text (no escape character)."""
    return "'%" + q.replace("'", "''") + "%'"


def search(q: str, cols: list[str]) -> str:
    return "(" + " OR ".join(f"COALESCE({c}, '') ILIKE {like(q)}" for c in cols) + ")"


def in_list(col: str, values: list[str]) -> str:
    return f"{col} IN (" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# ---- snapshot history ----------------------------------------------------------

SNAP_DAY = """snap_day AS (
  SELECT CAST(Created_At AS DATE) AS day,
         count(*) AS n,
         count(*) FILTER (WHERE State = 'open') AS sec_open,
         count(*) FILTER (WHERE Publicly_Leaked IN ('True', 'true')) AS sec_leaked,
         count(*) FILTER (WHERE COALESCE(Push_Protection_Bypassed IN ('True', 'true'), false))
           AS sec_bypassed,
         count(DISTINCT Organization_Name) AS n_orgs,
         count(DISTINCT Repository_Name) AS n_repos,
         count(*) FILTER (WHERE Alert_Number % 3 = 0) AS dep_open,
         count(*) FILTER (WHERE Alert_Number % 3 = 1) AS dep_fixed,
         count(*) FILTER (WHERE Alert_Number % 3 = 2) AS dep_dismissed,
         count(*) FILTER (WHERE Secret_Type = 'error') AS dep_critical,
         count(*) FILTER (WHERE Secret_Type = 'purchase') AS dep_high,
         count(*) FILTER (WHERE Secret_Type = 'click') AS dep_medium,
         count(*) FILTER (WHERE Secret_Type = 'view') AS dep_low
  FROM secrets GROUP BY 1
)"""

CANDIDATES = """candidates AS (
  SELECT CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR + INTERVAL 20 SECOND AS timestamp,
         'secrets' AS source, 'sec-' || strftime(day, '%Y%m%d') AS fingerprint,
         n AS total, sec_open AS open, 0 AS critical, 0 AS high, 0 AS medium, 0 AS low,
         0 AS fixed, n - sec_open AS dismissed, sec_leaked AS leaked, sec_bypassed AS bypassed,
         n_orgs AS orgs, n_repos AS repos
  FROM snap_day
  UNION ALL
  SELECT CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR + INTERVAL 40 SECOND,
         'dependabot', 'dep-' || strftime(day, '%Y%m%d'),
         n, dep_open, dep_critical, dep_high, dep_medium, dep_low, dep_fixed, dep_dismissed,
         0, 0, n_orgs, n_repos
  FROM snap_day
  UNION ALL
  SELECT CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR + INTERVAL 50 SECOND,
         'dependabot', 'dep-' || strftime(day, '%Y%m%d') || '-b',
         n - dep_fixed, dep_open, dep_critical, dep_high, dep_medium, dep_low, 0, dep_dismissed,
         0, 0, n_orgs, n_repos
  FROM snap_day WHERE dayofmonth(day) % 5 = 0
  UNION ALL
  SELECT CAST(day AS TIMESTAMP) + INTERVAL 18 HOUR,
         'secrets', 'sec-' || strftime(day, '%Y%m%d'),
         n + 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0
  FROM snap_day WHERE dayofmonth(day) % 7 = 0
)"""

# First candidate per key: earliest timestamp, then smallest metrics.
FIRSTS = """firsts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY source, fingerprint
      ORDER BY timestamp, total, open, critical, high, medium, low, fixed, dismissed,
               leaked, bypassed, orgs, repos) AS rn
    FROM {src}
  ) WHERE rn = 1
)"""

# Two appends: first the candidates of days 1-15 into an empty history, then
# all candidates (known keys skipped; ids continue).
HISTORY = (
    FIRSTS.format(src="(SELECT * FROM candidates WHERE dayofmonth(timestamp) <= 15)")
    .replace("firsts AS", "batch1 AS")
    + ",\n"
    + """history1 AS (
  SELECT row_number() OVER (ORDER BY timestamp, source, fingerprint) AS id,
         timestamp, source, fingerprint, """ + SNAPSHOT_METRICS + """
  FROM batch1
),
"""
    + FIRSTS.format(src="candidates").replace("firsts AS", "batch2 AS")
    + ",\n"
    + """fresh2 AS (
  SELECT b.* FROM batch2 b
  WHERE NOT EXISTS (SELECT 1 FROM history1 h
                    WHERE h.source = b.source AND h.fingerprint = b.fingerprint)
),
history AS (
  SELECT id, timestamp, source, fingerprint, """ + SNAPSHOT_METRICS + """ FROM history1
  UNION ALL
  SELECT (SELECT COALESCE(max(id), 0) FROM history1)
           + row_number() OVER (ORDER BY timestamp, source, fingerprint) AS id,
         timestamp, source, fingerprint, """ + SNAPSHOT_METRICS + """
  FROM fresh2
)"""
)

MERGED = """merged AS (
  SELECT strftime(timestamp, '%Y-%m-%dT%H:%M') AS timestamp,
         arg_max(total, CASE WHEN source = 'dependabot' THEN struct_pack(t := timestamp, i := id) END)
           AS dep_total,
         arg_max(open, CASE WHEN source = 'dependabot' THEN struct_pack(t := timestamp, i := id) END)
           AS dep_open,
         arg_max(critical, CASE WHEN source = 'dependabot' THEN struct_pack(t := timestamp, i := id) END)
           AS dep_critical,
         arg_max(total, CASE WHEN source = 'secrets' THEN struct_pack(t := timestamp, i := id) END)
           AS sec_total,
         arg_max(open, CASE WHEN source = 'secrets' THEN struct_pack(t := timestamp, i := id) END)
           AS sec_open,
         arg_max(leaked, CASE WHEN source = 'secrets' THEN struct_pack(t := timestamp, i := id) END)
           AS sec_leaked
  FROM history GROUP BY 1
)"""

TIMELINE_CTES = [SECRETS, SNAP_DAY, CANDIDATES, HISTORY]
