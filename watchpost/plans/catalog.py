"""The query catalog: one Spark plan and one DuckDB oracle per operator ID.

``(spark, sf_dir)``, reads the driver's tables in full (through the derived
datasets of ``watchpost.sources.views``) and returns a DataFrame whose rows
have passed ``deliver`` (timestamps as ISO text, non-finite doubles as
NULL).  The oracle is written from the same definitions, with the same
tie-breaks; IDs with no SQL equivalent have no oracle entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpost.functions import clean, scalar
from watchpost.functions.clean import deliver
from watchpost.operators import breakdowns as bd
from watchpost.operators import filters as flt
from watchpost.operators import metrics as met
from watchpost.operators import options as opt
from watchpost.operators import overview as ovw
from watchpost.operators import paging as pg
from watchpost.operators import timeline as tl
from watchpost.plans import oracle as O
from watchpost.schema import ALERT_DATE_COLUMNS, ALERT_DISPLAY_COLUMNS, DEPS_COLUMNS
from watchpost.session import scratch_dir
from watchpost.sources import csv as src
from watchpost.sources import export, store, views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _alerts(spark, d):
    return views.alerts(spark, d)


def _secrets(spark, d):
    return views.secrets(spark, d)


def _deps(spark, d):
    return views.dependencies(spark, d)


WA = O.with_(O.ALERTS)
WS = O.with_(O.SECRETS)
WD = O.with_(O.DEPS)
WAS = O.with_(O.ALERTS, O.SECRETS)


def _scratch(spark: SparkSession, what: str) -> str:
    return scratch_dir(spark, f"watchpost-io/{what}")


# ---- parameters of the registered filter / page / typeahead calls ------------

ALERT_FILTER = dict(severity=["critical", "high"], state=["open", "dismissed"],
                    ecosystem=["BUILDING", "MACHINERY", "HOUSEHOLD"],
                    org=["NATION_1", "NATION_5", "NATION_12", "NATION_23"])
ALERT_SEARCH = "cve-4_"
DEPS_FILTER = dict(org=["NATION_3", "NATION_7", "NATION_11"], is_open_source="true")
DEPS_SEARCH = "RING"
SECRET_FILTER = dict(secret_type=["error", "purchase"], validity=["active", "unknown"],
                     search="repo-1")
EXPORT_ALERTS = dict(search="urgent", state=["open", "fixed"])
EXPORT_DEPS = dict(search="bolt", package_file=["SMALL", "LARGE"])
EXPORT_SECRETS = dict(state=["open"], org=["NATION_4", "NATION_9"])


def _alert_where(f: dict, search: str = "") -> str:
    names = {"severity": "Severity", "state": "State", "ecosystem": "Dependency_Package_Ecosystem",
             "org": "Organization_Name"}
    parts = [O.in_list(names[k], v) for k, v in f.items() if k in names and v]
    q = search or f.get("search", "")
    if q:
        parts.append(O.search(q, ["Advisory_Summary", "CVE_ID", "Dependency_Package_Name",
                                  "Repository_Name", "Organization_Name"]))
    return ("WHERE " + " AND ".join(parts)) if parts else ""


def _deps_where(f: dict, search: str = "") -> str:
    names = {"org": "org_name", "repo": "repo_name", "package_file": "package_name"}
    parts = [O.in_list(names[k], v) for k, v in f.items() if k in names and v]
    if f.get("is_open_source") is not None:
        parts.append("is_open_source = '" + f["is_open_source"] + "'")
    q = search or f.get("search", "")
    if q:
        parts.append(O.search(q, ["dependency_name", "repo_name", "package_name", "org_name"]))
    return ("WHERE " + " AND ".join(parts)) if parts else ""


def _secret_where(f: dict) -> str:
    names = {"secret_type": "Secret_Type", "state": "State", "validity": "Validity",
             "org": "Organization_Name"}
    parts = [O.in_list(names[k], v) for k, v in f.items() if k in names and v]
    if f.get("search"):
        parts.append(O.search(f["search"], ["Secret_Type", "Repository_Name", "Organization_Name"]))
    return ("WHERE " + " AND ".join(parts)) if parts else ""


# =============================================================================
# 2.1 sources and sinks
# =============================================================================

@register("src_alerts_csv", f"{WA}SELECT {O.ALERT_COLS} FROM alerts")
def q_src_alerts_csv(spark, d):
    path = export.write_csv(_alerts(spark, d), _scratch(spark, "alerts-csv"))
    return deliver(src.alerts(spark, path))


@register("src_alerts_csv_types", f"""{WA}SELECT Alert_Number, Organization_Name, Alert_Number * 3 - 7 AS Points,
  Alert_Number / 4.0::DOUBLE AS Weight, Alert_Number % 2 = 0 AS Is_Even, CAST(Created_At AS DATE) AS Seen_On,
  strftime(Created_At, '%Y-%m-%dT%H:%M:%S') AS Seen_At,
  CASE WHEN Alert_Number % 5 = 0 THEN 'n/a' ELSE CAST(Alert_Number AS VARCHAR) END AS Mixed,
  CASE WHEN Alert_Number % 2 = 0 THEN CAST(Alert_Number AS VARCHAR) ELSE Alert_Number || '.5' END::DOUBLE AS Both
  FROM alerts""")
def q_src_alerts_csv_types(spark, d):
    """Further columns get the types that their values have, over two headers."""
    a, n = _alerts(spark, d), F.col("Alert_Number")
    both = F.when(n % 2 == 0, n.cast("string")).otherwise(F.concat(n, F.lit(".5")))
    out = a.select(
        "Alert_Number", "Organization_Name", (n * 3 - 7).alias("Points"), (n / 4).alias("Weight"),
        (n % 2 == 0).alias("Is_Even"), F.to_date("Created_At").alias("Seen_On"),
        F.date_format("Created_At", "yyyy-MM-dd HH:mm:ss").alias("Seen_At"),
        F.when(n % 5 == 0, "n/a").otherwise(n.cast("string")).alias("Mixed"), both.alias("Both"),
    )
    path = export.write_csv(out.where(n % 2 == 0), _scratch(spark, "types-csv"))
    odd = out.where((n % 2 != 0) | n.isNull())
    export.write_csv(odd.select(*reversed(out.columns)), path, mode="append")
    return deliver(src.alerts(spark, path)).select(*out.columns)


@register("src_deps_csv_split", f"""{WD}SELECT org_name, repo_name, package_name,
  'a ""quoted"", ' || dependency_name || chr(10) || 'text' AS dependency_name, is_open_source FROM deps""".replace('""', '"'))
def q_src_deps_csv_split(spark, d):
    """Files with quoted newlines, each read by many tasks."""
    text = F.concat(F.lit('a "quoted", '), "dependency_name", F.lit("\ntext"))
    rows = _deps(spark, d).withColumn("dependency_name", text)
    path = export.write_csv(rows, _scratch(spark, "split-csv"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, 128 * 1024)
    try:
        # The splits are fixed while the setting holds.
        found = src.deps(spark, path).select(*DEPS_COLUMNS)
    finally:
        spark.conf.set(key, before)
    return deliver(found)


@register("src_secrets_csv", f"{WS}SELECT {O.SECRET_COLS} FROM secrets")
def q_src_secrets_csv(spark, d):
    path = export.write_csv(_secrets(spark, d), _scratch(spark, "secrets-csv"))
    return deliver(src.secrets(spark, path))


@register("src_deps_csv", f"""{WD}SELECT org_name, repo_name, package_name,
  CASE WHEN is_open_source = 'true' THEN '  ' || dependency_name || ' ' ELSE dependency_name END
    AS dependency_name, is_open_source,
  CASE WHEN is_open_source = 'true' THEN '/' || package_name END AS manifest_path FROM deps""")
def q_src_deps_csv(spark, d):
    """Part files with two headers: other column order, and an extra column in some."""
    path = _scratch(spark, "deps-csv")
    rows = _odd_csv(spark, d)
    extra = rows.where("is_open_source = 'true'").select(
        F.concat(F.lit("/"), "package_name").alias("manifest_path"), *reversed(DEPS_COLUMNS))
    export.write_csv(extra, path)
    export.write_csv(rows.where("is_open_source IS NULL OR is_open_source <> 'true'"), path, mode="append")
    return deliver(src.deps(spark, path))


def _odd_csv(spark, d):
    """Dependencies with blanks at both ends of a text."""
    padded = F.concat(F.lit("  "), F.col("dependency_name"), F.lit(" "))
    return _deps(spark, d).withColumn(
        "dependency_name", F.when(F.col("is_open_source") == "true", padded).otherwise(F.col("dependency_name"))
    )


@register("src_discover", f"{WA}SELECT {O.ALERT_COLS} FROM alerts WHERE State = 'open'")
def q_src_discover(spark, d):
    drop = _scratch(spark, "drop")
    a = _alerts(spark, d)
    export.write_csv(a, f"{drop}/dependabot_alerts_b.csv")
    export.write_csv(a.where(F.col("State") == "open"), f"{drop}/dependabot_alerts_a.csv")
    export.write_csv(_secrets(spark, d), f"{drop}/secret_scanning_0.csv")
    # Not a match: the underscore of the pattern is no wildcard.
    export.write_csv(a, f"{drop}/dependabot-alerts.csv")
    chosen = src.discover(spark, drop, "alerts")
    return deliver(src.alerts(spark, chosen))


@register("src_fingerprint", "SELECT true AS is_12_hex, true AS is_stable, true AS follows_change")
def q_src_fingerprint(spark, d):
    """The id is 12 hex digits, the same for the same files, another after a change."""
    path = export.write_csv(_deps(spark, d), _scratch(spark, "fp"))
    first, again = store.fingerprint(spark, path), store.fingerprint(spark, path)
    export.write_csv(_deps(spark, d).where("is_open_source IS NULL"), path, mode="append")
    changed = store.fingerprint_frame(spark, path)
    return changed.select(
        F.col("fingerprint").rlike("^[0-9a-f]{12}$").alias("is_12_hex"), F.lit(first == again).alias("is_stable"),
        (F.col("fingerprint") != F.lit(first)).alias("follows_change"),
    )


@register("sink_store", f"{WA}SELECT {O.ALERT_COLS}, true AS reused FROM alerts")
def q_sink_store(spark, d):
    path = export.write_csv(_alerts(spark, d), _scratch(spark, "store-in"))
    root = _scratch(spark, "store")

    def ingest():
        df = store.store(spark, path, root, "alerts", record_snapshot=False)
        return df, sorted(df.inputFiles())

    _, written = ingest()
    # The second ingest of the unchanged file reads the very files of the first.
    df, reused = ingest()
    return deliver(df.withColumn("reused", F.lit(written == reused)))


@register("sink_alerts_export",
          f"{WA}SELECT {O.ALERT_COLS} FROM alerts {_alert_where(EXPORT_ALERTS)}")
def q_sink_alerts_export(spark, d):
    path = export.alerts(_alerts(spark, d), _scratch(spark, "export-alerts"), **EXPORT_ALERTS)
    return deliver(src.alerts(spark, path))


@register("sink_deps_export", f"{WD}SELECT {O.DEPS_COLS} FROM deps {_deps_where(EXPORT_DEPS)}")
def q_sink_deps_export(spark, d):
    path = export.deps(_deps(spark, d), _scratch(spark, "export-deps"), **EXPORT_DEPS)
    return deliver(src.deps(spark, path))


@register("sink_secrets_export",
          f"{WS}SELECT {O.SECRET_COLS} FROM secrets {_secret_where(EXPORT_SECRETS)}")
def q_sink_secrets_export(spark, d):
    path = export.secrets(_secrets(spark, d), _scratch(spark, "export-secrets"), **EXPORT_SECRETS)
    return deliver(src.secrets(spark, path))


# =============================================================================
# 2.2 cleaning projections and scalar functions
# =============================================================================

_RAW_DATES_SQL = (
    "CASE WHEN Alert_Number % 11 = 0 THEN 'not a date' WHEN Alert_Number % 11 = 1 THEN '12:30:00' "
    "WHEN Alert_Number % 11 = 2 THEN '2024' WHEN Alert_Number % 11 = 3 THEN '2024-05' "
    "ELSE strftime(Created_At, '%Y-%m-%d %H:%M:%S') END"
)
_RAW_UPDATED_SQL = (
    "CASE WHEN Alert_Number % 3 = 0 THEN '' "
    "ELSE strftime(Created_At + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END"
)


@register("cln_try_timestamp",
          f"{WA}SELECT Alert_Number, "
          f"{O.iso('TRY_CAST(' + _RAW_DATES_SQL + ' AS TIMESTAMP)')} AS Created_At, "
          f"{O.iso('TRY_CAST(' + _RAW_UPDATED_SQL + ' AS TIMESTAMP)')} AS Updated_At "
          f"FROM alerts")
def q_cln_try_timestamp(spark, d):
    a = _alerts(spark, d)
    key = F.col("Alert_Number")
    raw = a.select(
        "Alert_Number",
        F.when(key % 11 == 0, F.lit("not a date")).when(key % 11 == 1, F.lit("12:30:00"))
        .when(key % 11 == 2, F.lit("2024")).when(key % 11 == 3, F.lit("2024-05"))
        .otherwise(F.date_format("Created_At", "yyyy-MM-dd HH:mm:ss")).alias("Created_At"),
        F.when(key % 3 == 0, F.lit(""))
        .otherwise(F.date_format(F.col("Created_At") + F.expr("INTERVAL 1 DAY"),
                                 "yyyy-MM-dd HH:mm:ss")).alias("Updated_At"),
    )
    return deliver(clean.try_timestamp(raw, ALERT_DATE_COLUMNS))


@register("cln_try_double",
          f"{WA}SELECT Alert_Number, TRY_CAST(CASE WHEN Alert_Number % 5 = 0 THEN CVSS_Score || 'd' "
          "WHEN Alert_Number % 5 = 1 THEN CVSS_Score || 'F' ELSE CVSS_Score END AS DOUBLE) AS CVSS_Score FROM alerts")
def q_cln_try_double(spark, d):
    key, score = F.col("Alert_Number"), F.col("CVSS_Score")
    text = F.when(key % 5 == 0, F.concat(score, F.lit("d"))).when(key % 5 == 1, F.concat(score, F.lit("F")))
    a = _alerts(spark, d).select("Alert_Number", text.otherwise(score).alias("CVSS_Score"))
    return deliver(a.select("Alert_Number", clean.try_double("CVSS_Score").alias("CVSS_Score")))


_NONFINITE_TEXT_SQL = (
    "CASE WHEN Alert_Number % 17 = 0 THEN 'NaN' WHEN Alert_Number % 19 = 0 THEN 'Infinity' "
    "WHEN Alert_Number % 23 = 0 THEN '-Infinity' ELSE CVSS_Score END"
)


def _nonfinite_text(a: DataFrame):
    key = F.col("Alert_Number")
    return (
        F.when(key % 17 == 0, F.lit("NaN"))
        .when(key % 19 == 0, F.lit("Infinity"))
        .when(key % 23 == 0, F.lit("-Infinity"))
        .otherwise(F.col("CVSS_Score"))
    )


@register("cln_nonfinite_to_null",
          f"{WA}SELECT Alert_Number, "
          f"{O.finite('TRY_CAST(' + _NONFINITE_TEXT_SQL + ' AS DOUBLE)')} AS score FROM alerts")
def q_cln_nonfinite_to_null(spark, d):
    a = _alerts(spark, d)
    scored = a.select("Alert_Number", clean.try_double(_nonfinite_text(a)).alias("score"))
    return clean.nonfinite_to_null(scored)


# Text as it may come: whole numbers, and what only looks like one.
_NUMBER_TEXT = ["12", " -7 ", "+3", "1_000", "12.7", "1e3", "1.5d", "", "n/a", "9007199254740993"]
_NUMBER_TEXT_SQL = ("[" + ", ".join(f"'{t}'" for t in _NUMBER_TEXT) + "]"
                    f"[CAST(Alert_Number % {len(_NUMBER_TEXT)} AS INTEGER) + 1]")


@register("cln_safe_int", f"""{WA}SELECT Alert_Number,
  CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+(_[0-9]+)*')
       THEN CAST(replace(trim(t), '_', '') AS BIGINT) ELSE 0 END AS from_text,
  COALESCE(TRY_CAST(trunc({O.finite('x')}) AS BIGINT), 0) AS from_double,
  9007199254740993 + Alert_Number AS from_long
FROM (SELECT Alert_Number, {_NUMBER_TEXT_SQL} AS t, TRY_CAST({_NONFINITE_TEXT_SQL} AS DOUBLE) AS x FROM alerts)""")
def q_cln_safe_int(spark, d):
    a = _alerts(spark, d)
    key = F.col("Alert_Number")
    text = F.element_at(F.array(*[F.lit(t) for t in _NUMBER_TEXT]), (key % len(_NUMBER_TEXT)).cast("int") + 1)
    return a.select(
        "Alert_Number", text.alias("t"), clean.try_double(_nonfinite_text(a)).alias("x"),
        (F.lit(9007199254740993) + key).alias("n"),
    ).select(
        "Alert_Number", clean.safe_int("t").alias("from_text"), clean.safe_int("x").alias("from_double"),
        clean.safe_int("n").alias("from_long"),
    )


@register("cln_empty_to_null", f"{WD}SELECT {O.DEPS_COLS} FROM deps")
def q_cln_empty_to_null(spark, d):
    raw = _deps(spark, d).withColumn("is_open_source", F.coalesce("is_open_source", F.lit("")))
    return deliver(clean.empty_to_null(raw))


@register("prj_display_alerts", f"{WA}SELECT {O.ALERT_COLS} FROM alerts")
def q_prj_display_alerts(spark, d):
    a = _alerts(spark, d).withColumn("Fixed_At", F.col("Created_At")).withColumn(
        "Internal_Note", F.lit("x"))
    return deliver(clean.select_existing(a, ALERT_DISPLAY_COLUMNS))


@register("prj_display_deps", f"{WD}SELECT {O.DEPS_COLS} FROM deps")
def q_prj_display_deps(spark, d):
    dd = _deps(spark, d).withColumn("manifest_path", F.concat(F.lit("/"), F.col("package_name")))
    return deliver(clean.select_existing(dd, DEPS_COLUMNS))


@register("fn_flag_text",
          f"{WS}SELECT Alert_Number, "
          "COALESCE(CAST(Publicly_Leaked AS VARCHAR) IN ('True', 'true'), false) AS leaked, "
          "COALESCE(CAST(Push_Protection_Bypassed AS VARCHAR) IN ('True', 'true'), false) "
          "AS bypassed FROM secrets")
def q_fn_flag_text(spark, d):
    s = _secrets(spark, d)
    return s.select("Alert_Number", scalar.flag_text("Publicly_Leaked").alias("leaked"),
                    scalar.flag_text("Push_Protection_Bypassed").alias("bypassed"))


@register("fn_os_category",
          f"{WD}SELECT is_open_source, CASE WHEN lower(is_open_source) = 'true' "
          "THEN 'Open Source' ELSE 'Not Open Source' END AS category, count(*) AS count "
          "FROM deps GROUP BY 1, 2")
def q_fn_os_category(spark, d):
    dd = _deps(spark, d)
    return dd.groupBy("is_open_source", scalar.os_category("is_open_source").alias("category")) \
        .agg(F.count(F.lit(1)).alias("count"))


@register("fn_cvss_band",
          f"{WA}SELECT Alert_Number, CASE WHEN TRY_CAST(CVSS_Score AS DOUBLE) IS NULL THEN NULL "
          "WHEN TRY_CAST(CVSS_Score AS DOUBLE) >= 9 THEN 'critical' "
          "WHEN TRY_CAST(CVSS_Score AS DOUBLE) >= 7 THEN 'high' "
          "WHEN TRY_CAST(CVSS_Score AS DOUBLE) >= 4 THEN 'medium' ELSE 'low' END AS band "
          "FROM alerts")
def q_fn_cvss_band(spark, d):
    return _alerts(spark, d).select("Alert_Number", scalar.cvss_band("CVSS_Score").alias("band"))


@register("fn_cve_link",
          f"{WA}SELECT Alert_Number, CASE WHEN CVE_ID IS NULL OR CVE_ID = '' THEN NULL "
          "ELSE 'https://nvd.nist.gov/vuln/detail/' || CVE_ID END AS link FROM alerts")
def q_fn_cve_link(spark, d):
    return _alerts(spark, d).select("Alert_Number", scalar.cve_link("CVE_ID").alias("link"))


_LONG_TEXT_SQL = "repeat(Advisory_Summary || ' ', CAST(Alert_Number % 5 + 1 AS INTEGER))"


@register("fn_truncate",
          f"{WA}SELECT Alert_Number, CASE WHEN length({_LONG_TEXT_SQL}) > 80 "
          f"THEN substr({_LONG_TEXT_SQL}, 1, 80) || '…' ELSE {_LONG_TEXT_SQL} END AS summary "
          "FROM alerts")
def q_fn_truncate(spark, d):
    a = _alerts(spark, d)
    text = F.repeat(F.concat(F.col("Advisory_Summary"), F.lit(" ")),
                    (F.col("Alert_Number") % 5 + 1).cast("int"))
    return a.select("Alert_Number", scalar.truncate(text).alias("summary"))


@register("fn_iso_day",
          f"{WS}SELECT Alert_Number, strftime(Created_At, '%Y-%m-%d') AS day FROM secrets")
def q_fn_iso_day(spark, d):
    return _secrets(spark, d).select("Alert_Number", scalar.iso_day("Created_At").alias("day"))


# =============================================================================
# 2.3 filters
# =============================================================================

@register("flt_alerts", f"{WA}SELECT {O.ALERT_COLS} FROM alerts {_alert_where(ALERT_FILTER)}")
def q_flt_alerts(spark, d):
    return deliver(flt.alerts(_alerts(spark, d), **ALERT_FILTER))


@register("flt_alerts_search",
          f"{WA}SELECT {O.ALERT_COLS} FROM alerts {_alert_where({}, ALERT_SEARCH)}")
def q_flt_alerts_search(spark, d):
    return deliver(flt.alerts(_alerts(spark, d), search=ALERT_SEARCH))


@register("flt_deps", f"{WD}SELECT {O.DEPS_COLS} FROM deps {_deps_where(DEPS_FILTER)}")
def q_flt_deps(spark, d):
    return deliver(flt.deps(_deps(spark, d), **DEPS_FILTER))


@register("flt_deps_search", f"{WD}SELECT {O.DEPS_COLS} FROM deps {_deps_where({}, DEPS_SEARCH)}")
def q_flt_deps_search(spark, d):
    return deliver(flt.deps(_deps(spark, d), search=DEPS_SEARCH))


@register("flt_secrets", f"{WS}SELECT {O.SECRET_COLS} FROM secrets {_secret_where(SECRET_FILTER)}")
def q_flt_secrets(spark, d):
    return deliver(flt.secrets(_secrets(spark, d), **SECRET_FILTER))


# =============================================================================
# 2.4 paging
# =============================================================================

_ALERT_ORDER = ("ORDER BY Organization_Name ASC NULLS LAST, Repository_Name ASC NULLS LAST, "
                "Alert_Number ASC NULLS LAST")
_DEPS_ORDER = ("ORDER BY org_name ASC NULLS LAST, repo_name ASC NULLS LAST, "
               "dependency_name ASC NULLS LAST, package_name ASC NULLS LAST, "
               "is_open_source ASC NULLS LAST")


@register("page_alerts",
          f"{WA}SELECT {O.ALERT_COLS} FROM alerts WHERE State IN ('open') {_ALERT_ORDER} "
          "LIMIT 50 OFFSET 100")
def q_page_alerts(spark, d):
    return deliver(pg.alerts(flt.alerts(_alerts(spark, d), state=["open"]), 3, 50))


@register("page_deps",
          f"{WD}SELECT {O.DEPS_COLS} FROM deps {_DEPS_ORDER} LIMIT 500 OFFSET 12000")
def q_page_deps(spark, d):
    """A deep page over rows that repeat."""
    return deliver(pg.deps(_deps(spark, d), 25, 500))


@register("page_deps_deep", f"""{WD}SELECT {O.DEPS_COLS} FROM deps
  ORDER BY org_name NULLS LAST, repo_name NULLS LAST, dependency_name NULLS LAST, package_name NULLS LAST,
    is_open_source NULLS LAST
  LIMIT 100 OFFSET (SELECT count(*) // 100 - 5 FROM deps) * 100""")
def q_page_deps_deep(spark, d):
    """A page near the end: found by the counts of key ranges."""
    rows = _deps(spark, d)
    return deliver(pg.deps(rows, rows.count() // 100 - 4, 100))


@register("page_secrets",
          f"{WS}SELECT {O.SECRET_COLS} FROM secrets WHERE Organization_Name IN ('NATION_4') "
          f"{_ALERT_ORDER} LIMIT 50 OFFSET 0")
def q_page_secrets(spark, d):
    return deliver(pg.secrets(flt.secrets(_secrets(spark, d), org=["NATION_4"]), 1, 50))


def _envelope_sql(source: str, where: str, page: int, size: int) -> str:
    return (
        f"SELECT count(*) AS total, CAST({page} AS BIGINT) AS page, "
        f"CAST({size} AS BIGINT) AS page_size, "
        f"greatest(CAST(1 AS BIGINT), (count(*) + {size - 1}) // {size}) AS total_pages, "
        f"CAST({(page - 1) * size + 1} AS BIGINT) AS first_row, "
        f"least(CAST({page * size} AS BIGINT), count(*)) AS last_row FROM {source} {where}"
    )


@register("page_envelope", WA + _envelope_sql("alerts", "WHERE State IN ('open')", 3, 50))
def q_page_envelope(spark, d):
    return pg.envelope(flt.alerts(_alerts(spark, d), state=["open"]), 3, 50)


@register("page_span", WD + _envelope_sql("deps", _deps_where({}, "bolt"), 1000, 100))
def q_page_span(spark, d):
    return pg.envelope(flt.deps(_deps(spark, d), search="bolt"), 1000, 100)


# =============================================================================
# 2.5 distinct options and typeahead
# =============================================================================

def _options_sql(cte: str, source: str, options: dict[str, str]) -> str:
    union = " UNION ".join(
        f"SELECT '{name}' AS option, CAST({col} AS VARCHAR) AS value FROM {source}"
        for name, col in options.items()
    )
    return f"{cte}SELECT option, value FROM ({union}) WHERE value IS NOT NULL ORDER BY option, value"


@register("opt_alerts", _options_sql(WA, "alerts", {
    "severities": "Severity", "states": "State", "ecosystems": "Dependency_Package_Ecosystem"}))
def q_opt_alerts(spark, d):
    return opt.alerts(_alerts(spark, d))


@register("opt_deps", _options_sql(WD, "deps", {
    "package_files": "package_name", "is_open_source": "is_open_source"}))
def q_opt_deps(spark, d):
    return opt.deps(_deps(spark, d))


@register("opt_secrets", _options_sql(WS, "secrets", {
    "secret_types": "Secret_Type", "states": "State", "validities": "Validity"}))
def q_opt_secrets(spark, d):
    return opt.secrets(_secrets(spark, d))


def _typeahead_sql(cte: str, source: str, col: str, alias: str, q: str, limit: int) -> str:
    cond = f"{col} IS NOT NULL" + (f" AND {col} ILIKE {O.like(q)}" if q.strip() else "")
    return (f"{cte}SELECT DISTINCT {col} AS {alias} FROM {source} WHERE {cond} "
            f"ORDER BY {alias} LIMIT {limit}")


@register("ta_alert_orgs", _typeahead_sql(WA, "alerts", "Organization_Name", "org", "ation_1", 50))
def q_ta_alert_orgs(spark, d):
    return opt.typeahead(_alerts(spark, d), "Organization_Name", "ation_1", 50, alias="org")


@register("ta_deps_orgs", _typeahead_sql(WD, "deps", "org_name", "org", "", 5))
def q_ta_deps_orgs(spark, d):
    return opt.typeahead(_deps(spark, d), "org_name", "", 5, alias="org")


@register("ta_deps_repos", _typeahead_sql(WD, "deps", "repo_name", "repo", "#00000004", 50))
def q_ta_deps_repos(spark, d):
    return opt.typeahead(_deps(spark, d), "repo_name", "#00000004", 50, alias="repo")


@register("ta_secret_orgs", _typeahead_sql(WS, "secrets", "Organization_Name", "org", "  ", 10))
def q_ta_secret_orgs(spark, d):
    return opt.typeahead(_secrets(spark, d), "Organization_Name", "  ", 10, alias="org")


# =============================================================================
# 2.6 whole-table metrics
# =============================================================================

@register("met_alerts", WA + """SELECT total, open, fixed, dismissed, critical, high, medium, low,
  CASE WHEN isnan(a) OR isinf(a) THEN NULL ELSE COALESCE(a, 0.0) END AS avg_cvss,
  repos, orgs, cves
FROM (SELECT count(*) AS total,
             count(*) FILTER (WHERE State = 'open') AS open,
             count(*) FILTER (WHERE State = 'fixed') AS fixed,
             count(*) FILTER (WHERE State IN ('dismissed', 'auto_dismissed')) AS dismissed,
             count(*) FILTER (WHERE Severity = 'critical') AS critical,
             count(*) FILTER (WHERE Severity = 'high') AS high,
             count(*) FILTER (WHERE Severity = 'medium') AS medium,
             count(*) FILTER (WHERE Severity = 'low') AS low,
             round(avg(TRY_CAST(CVSS_Score AS DOUBLE)), 2) AS a,
             count(DISTINCT Repository_Name) AS repos,
             count(DISTINCT Organization_Name) AS orgs,
             count(DISTINCT CVE_ID) AS cves
      FROM alerts)""")
def q_met_alerts(spark, d):
    return met.alerts(_alerts(spark, d))


@register("met_deps", WD + """SELECT count(*) AS total_entries,
  count(DISTINCT dependency_name) AS unique_dependencies,
  count(DISTINCT repo_name) AS repos,
  count(DISTINCT org_name) AS orgs,
  count(DISTINCT package_name) AS package_files,
  count(*) FILTER (WHERE lower(is_open_source) = 'true') AS open_source,
  count(*) FILTER (WHERE lower(is_open_source) != 'true') AS not_open_source
FROM deps""")
def q_met_deps(spark, d):
    return met.deps(_deps(spark, d))


@register("met_secrets", WS + """SELECT count(*) AS total,
  count(*) FILTER (WHERE State = 'open') AS open,
  count(*) FILTER (WHERE State = 'resolved') AS resolved,
  count(*) FILTER (WHERE Validity = 'active') AS active,
  count(*) FILTER (WHERE Validity = 'inactive') AS inactive,
  count(*) FILTER (WHERE Validity = 'unknown') AS unknown,
  count(*) FILTER (WHERE CAST(Push_Protection_Bypassed AS VARCHAR) IN ('True', 'true'))
    AS push_bypassed,
  count(*) FILTER (WHERE CAST(Publicly_Leaked AS VARCHAR) IN ('True', 'true')) AS publicly_leaked,
  count(DISTINCT Secret_Type) AS secret_types,
  count(DISTINCT Repository_Name) AS repos,
  count(DISTINCT Organization_Name) AS orgs
FROM secrets""")
def q_met_secrets(spark, d):
    return met.secrets(_secrets(spark, d))


# =============================================================================
# 2.7 grouped breakdowns
# =============================================================================

def _count_sql(cte: str, source: str, key: str, alias: str, k: int | None = None,
               where: str = "") -> str:
    lim = f" LIMIT {k}" if k else ""
    return (f"{cte}SELECT {key} AS {alias}, count(*) AS count FROM {source} {where} "
            f"GROUP BY 1 ORDER BY count DESC, {alias} ASC NULLS LAST{lim}")


_ORG_AGG = ("SELECT Organization_Name AS org, count(*) AS total, "
            "count(*) FILTER (WHERE State = 'open') AS open, "
            "count(DISTINCT Repository_Name) AS repos FROM {src} GROUP BY 1 "
            "ORDER BY total DESC, org ASC NULLS LAST LIMIT 20")


def _trend_sql(cte: str, source: str) -> str:
    return (f"{cte}SELECT CAST(CAST(Created_At AS DATE) AS VARCHAR) AS date, count(*) AS count "
            f"FROM {source} WHERE Created_At IS NOT NULL GROUP BY 1 ORDER BY 1")


@register("agg_alert_severity", _count_sql(WA, "alerts", "Severity", "Severity"))
def q_agg_alert_severity(spark, d):
    return bd.alert_severity(_alerts(spark, d))


@register("agg_alert_state", _count_sql(WA, "alerts", "State", "State"))
def q_agg_alert_state(spark, d):
    return bd.alert_state(_alerts(spark, d))


@register("agg_alert_ecosystem",
          _count_sql(WA, "alerts", "Dependency_Package_Ecosystem", "ecosystem", 10))
def q_agg_alert_ecosystem(spark, d):
    return bd.alert_ecosystem(_alerts(spark, d))


@register("agg_alert_org", WA + _ORG_AGG.format(src="alerts"))
def q_agg_alert_org(spark, d):
    return bd.alert_org(_alerts(spark, d))


@register("agg_alert_trend", _trend_sql(WA, "alerts"))
def q_agg_alert_trend(spark, d):
    return bd.alert_trend(_alerts(spark, d))


@register("agg_secret_type", _count_sql(WS, "secrets", "Secret_Type", "Secret_Type"))
def q_agg_secret_type(spark, d):
    return bd.secret_type(_secrets(spark, d))


@register("agg_secret_state", _count_sql(WS, "secrets", "State", "State"))
def q_agg_secret_state(spark, d):
    return bd.secret_state(_secrets(spark, d))


@register("agg_secret_validity", _count_sql(WS, "secrets", "Validity", "Validity"))
def q_agg_secret_validity(spark, d):
    return bd.secret_validity(_secrets(spark, d))


@register("agg_secret_org", WS + _ORG_AGG.format(src="secrets"))
def q_agg_secret_org(spark, d):
    return bd.secret_org(_secrets(spark, d))


@register("agg_secret_trend", _trend_sql(WS, "secrets"))
def q_agg_secret_trend(spark, d):
    return bd.secret_trend(_secrets(spark, d))


@register("agg_deps_manifest", _count_sql(WD, "deps", "package_name", "package_file", 15))
def q_agg_deps_manifest(spark, d):
    return bd.deps_manifest(_deps(spark, d))


@register("agg_deps_org", WD + """SELECT org_name AS org, count(*) AS total_deps,
  count(DISTINCT dependency_name) AS unique_deps, count(DISTINCT repo_name) AS repos
FROM deps GROUP BY 1 ORDER BY total_deps DESC, org ASC NULLS LAST LIMIT 20""")
def q_agg_deps_org(spark, d):
    return bd.deps_org(_deps(spark, d))


@register("agg_deps_repo", WD + """SELECT repo_name AS repo, org_name AS org, count(*) AS total_deps,
  count(DISTINCT dependency_name) AS unique_deps
FROM deps GROUP BY 1, 2 ORDER BY total_deps DESC, repo ASC NULLS LAST, org ASC NULLS LAST LIMIT 20""")
def q_agg_deps_repo(spark, d):
    return bd.deps_repo(_deps(spark, d))


@register("agg_deps_top", WD + """SELECT dependency_name AS dependency, count(*) AS repo_count,
  count(DISTINCT repo_name) AS repos
FROM deps GROUP BY 1 ORDER BY repo_count DESC, dependency ASC NULLS LAST LIMIT 20""")
def q_agg_deps_top(spark, d):
    return bd.deps_top(_deps(spark, d))


@register("agg_deps_open_source", WD + """SELECT CASE WHEN lower(is_open_source) = 'true'
  THEN 'Open Source' ELSE 'Not Open Source' END AS category, count(*) AS count
FROM deps GROUP BY 1 ORDER BY count DESC, category""")
def q_agg_deps_open_source(spark, d):
    return bd.deps_open_source(_deps(spark, d))


@register("agg_share", WA + """SELECT Severity, count, count / sum(count) OVER () AS share,
  CAST(round(count / sum(count) OVER () * 100, 0) AS BIGINT) AS percent
FROM (SELECT Severity, count(*) AS count FROM alerts GROUP BY 1)""")
def q_agg_share(spark, d):
    return bd.share(bd.alert_severity(_alerts(spark, d)))


# =============================================================================
# 2.8 overview and history
# =============================================================================

_OVW_DEP = """d AS (
  SELECT Organization_Name AS org, count(*) AS total,
         count(*) FILTER (WHERE State = 'open') AS open,
         count(*) FILTER (WHERE Severity = 'critical') AS critical,
         count(*) FILTER (WHERE Severity = 'high') AS high,
         count(DISTINCT Repository_Name) AS repos
  FROM alerts WHERE Organization_Name IS NOT NULL GROUP BY 1
)"""
_OVW_SEC = """s AS (
  SELECT Organization_Name AS org, count(*) AS total,
         count(*) FILTER (WHERE State = 'open') AS open,
         count(*) FILTER (WHERE CAST(Publicly_Leaked AS VARCHAR) IN ('True', 'true')) AS leaked,
         count(*) FILTER (WHERE CAST(Push_Protection_Bypassed AS VARCHAR) IN ('True', 'true'))
           AS bypassed,
         count(DISTINCT Repository_Name) AS repos
  FROM secrets WHERE Organization_Name IS NOT NULL GROUP BY 1
)"""
_BOARD = """board AS (
  SELECT COALESCE(d.org, s.org) AS org,
         COALESCE(d.total, 0) AS dep_total, COALESCE(d.open, 0) AS dep_open,
         COALESCE(d.critical, 0) AS dep_critical, COALESCE(d.high, 0) AS dep_high,
         COALESCE(s.total, 0) AS sec_total, COALESCE(s.open, 0) AS sec_open,
         COALESCE(s.leaked, 0) AS sec_leaked, COALESCE(s.bypassed, 0) AS sec_bypassed,
         COALESCE(d.total, 0) + COALESCE(s.total, 0) AS total_vulns,
         COALESCE(d.open, 0) + COALESCE(s.open, 0) AS total_open,
         greatest(COALESCE(d.repos, 0), COALESCE(s.repos, 0)) AS repos
  FROM d FULL OUTER JOIN s ON d.org = s.org
)"""
_MX = "mx AS (SELECT COALESCE(max(total_vulns), 0) AS m FROM board)"
_RISK = """CASE WHEN dep_critical > 0 OR sec_leaked > 0 THEN 'Critical'
       WHEN dep_high > 0 OR sec_bypassed > 0 THEN 'High'
       WHEN total_open = 0 AND total_vulns = 0 THEN 'None'
       WHEN (CASE WHEN m > 0 THEN total_open / m ELSE 0.0 END) >= 0.25 THEN 'Medium'
       ELSE 'Low' END"""
WBOARD = O.with_(O.ALERTS, O.SECRETS, _OVW_DEP, _OVW_SEC, _BOARD, _MX)


@register("ovw_org_alerts", O.with_(O.ALERTS, _OVW_DEP) + "SELECT * FROM d")
def q_ovw_org_alerts(spark, d):
    return ovw.org_alerts(_alerts(spark, d))


@register("ovw_org_secrets", O.with_(O.SECRETS, _OVW_SEC) + "SELECT * FROM s")
def q_ovw_org_secrets(spark, d):
    return ovw.org_secrets(_secrets(spark, d))


@register("ovw_orgs", WBOARD + "SELECT * FROM board ORDER BY total_vulns DESC, org")
def q_ovw_orgs(spark, d):
    return ovw.orgs(_alerts(spark, d), _secrets(spark, d))


@register("ovw_totals", WAS + """, u AS (
  SELECT true AS is_dep, State = 'open' AS is_open, Severity = 'critical' AS is_critical,
         false AS is_leaked, Organization_Name AS org FROM alerts
  UNION ALL
  SELECT false, State = 'open', false,
         COALESCE(CAST(Publicly_Leaked AS VARCHAR) IN ('True', 'true'), false),
         Organization_Name FROM secrets
), t AS (
  SELECT count(*) FILTER (WHERE is_dep) AS dep_total,
         count(*) FILTER (WHERE is_dep AND is_open) AS dep_open,
         count(*) FILTER (WHERE NOT is_dep) AS sec_total,
         count(*) FILTER (WHERE NOT is_dep AND is_open) AS sec_open,
         count(*) FILTER (WHERE is_critical) AS critical,
         count(*) FILTER (WHERE is_leaked) AS leaked,
         count(DISTINCT org) AS orgs
  FROM u
)
SELECT dep_total + sec_total AS total_vulns, dep_open + sec_open AS total_open,
       CASE WHEN dep_total + sec_total > 0
            THEN round((dep_open + sec_open) / (dep_total + sec_total) * 100, 1)
            ELSE 0.0 END AS open_pct,
       dep_total, dep_open, critical, sec_total, sec_open, leaked, orgs
FROM t""")
def q_ovw_totals(spark, d):
    return ovw.totals(_alerts(spark, d), _secrets(spark, d))


@register("ovw_risk", WBOARD + f"SELECT board.*, {_RISK} AS risk FROM board, mx")
def q_ovw_risk(spark, d):
    return ovw.risk(ovw.orgs(_alerts(spark, d), _secrets(spark, d)))


@register("ovw_heat", WBOARD + f"""SELECT org, total_vulns, risk,
  CASE WHEN m = 0 OR risk = 'None' THEN 0.5
       ELSE CAST(0.25 AS DOUBLE) + least(total_vulns / m, CAST(1.0 AS DOUBLE))
            * CAST(0.65 AS DOUBLE) END AS intensity
FROM (SELECT board.*, m, {_RISK} AS risk FROM board, mx)
ORDER BY total_vulns DESC, org LIMIT 40""")
def q_ovw_heat(spark, d):
    return ovw.heat(ovw.orgs(_alerts(spark, d), _secrets(spark, d)))


@register("ovw_rank", WBOARD + """SELECT row_number() OVER (ORDER BY total_vulns DESC, org) AS rank,
  org, total_vulns, CASE WHEN m > 0 THEN total_vulns / m * 100 ELSE 0.0 END AS bar
FROM board, mx ORDER BY rank""")
def q_ovw_rank(spark, d):
    return ovw.rank(ovw.orgs(_alerts(spark, d), _secrets(spark, d)))


def _history(spark, d) -> DataFrame:
    """Two appends: candidates of days 1-15 into an empty history, then all."""
    path = _scratch(spark, "timeline")
    cands = views.snapshot_candidates(spark, d)
    tl.append(spark, path, cands.where(F.dayofmonth("timestamp") <= 15))
    tl.append(spark, path, cands)
    return tl.read_raw(spark, path)


WTL = O.with_(*O.TIMELINE_CTES)


@register("tl_append", WTL + f"SELECT id, {O.iso('timestamp')} AS timestamp, source, fingerprint, "
          f"{O.SNAPSHOT_METRICS} FROM history")
def q_tl_append(spark, d):
    return deliver(_history(spark, d))


_SEED_SQL = ("SELECT {id} AS id, {iso} AS timestamp, '{source}' AS source, '{fp}' AS fingerprint, total, open, "
             "critical, high, medium, low, fixed, dismissed, leaked, bypassed, orgs, repos FROM {frm}")


@register("tl_backfill", WAS + f""", past AS (SELECT max(Created_At) - INTERVAL 3 DAY AS ts FROM secrets),
dep AS (SELECT count(*) AS total, count(*) FILTER (WHERE State = 'open') AS open,
  count(*) FILTER (WHERE Severity = 'critical') AS critical, count(*) FILTER (WHERE Severity = 'high') AS high,
  count(*) FILTER (WHERE Severity = 'medium') AS medium, count(*) FILTER (WHERE Severity = 'low') AS low,
  count(*) FILTER (WHERE State = 'fixed') AS fixed,
  count(*) FILTER (WHERE State IN ('dismissed', 'auto_dismissed')) AS dismissed,
  CAST(0 AS BIGINT) AS leaked, CAST(0 AS BIGINT) AS bypassed,
  count(DISTINCT Organization_Name) AS orgs, count(DISTINCT Repository_Name) AS repos FROM alerts),
sec AS (SELECT count(*) AS total, count(*) FILTER (WHERE State = 'open') AS open, CAST(0 AS BIGINT) AS critical,
  CAST(0 AS BIGINT) AS high, CAST(0 AS BIGINT) AS medium, CAST(0 AS BIGINT) AS low, CAST(0 AS BIGINT) AS fixed,
  CAST(0 AS BIGINT) AS dismissed, count(*) FILTER (WHERE Publicly_Leaked IN ('True', 'true')) AS leaked,
  count(*) FILTER (WHERE Push_Protection_Bypassed IN ('True', 'true')) AS bypassed,
  count(DISTINCT Organization_Name) AS orgs, count(DISTINCT Repository_Name) AS repos FROM secrets)
{_SEED_SQL.format(id="CAST(1 AS BIGINT)", iso=O.iso("ts"), source="dependabot", fp="baseline", frm="dep, past")}
UNION ALL
{_SEED_SQL.format(id="CAST(2 AS BIGINT)", iso=O.iso("ts"), source="secrets", fp="original_seed", frm="sec, past")}""")
def q_tl_backfill(spark, d):
    """Both baselines, stamped three days back, inserted once however often they are."""
    path = _scratch(spark, "backfill")
    now = _secrets(spark, d).agg(F.max("Created_At")).first()[0]
    for _ in range(2):
        tl.append(spark, path, tl.backfill(met.alerts(_alerts(spark, d)), "dependabot", "baseline", now))
        tl.append(spark, path, tl.backfill(met.secrets(_secrets(spark, d)), "secrets", "original_seed", now))
    return deliver(tl.read_raw(spark, path))


@register("tl_read", WTL + f"SELECT {O.iso('timestamp')} AS timestamp, source, "
          f"{O.SNAPSHOT_METRICS} FROM history WHERE source = 'secrets' ORDER BY timestamp, id")
def q_tl_read(spark, d):
    return tl.read(_history(spark, d), source="secrets")


@register("tl_merge", O.with_(*O.TIMELINE_CTES, O.MERGED) + "SELECT * FROM merged ORDER BY timestamp")
def q_tl_merge(spark, d):
    return tl.merge(_history(spark, d))


@register("tl_window", O.with_(*O.TIMELINE_CTES, O.MERGED) + """, pos AS (
  SELECT merged.*, row_number() OVER (ORDER BY timestamp) - 1 AS pos FROM merged
), b AS (
  SELECT count(*) - 1 AS r0, greatest(1, CAST(floor((count(*) - 1) * 0.25) AS BIGINT)) AS step
  FROM merged
)
SELECT pos.* FROM pos, b
WHERE pos >= least(step, r0 - 1) AND pos <= greatest(r0 - step, 1)
ORDER BY pos""")
def q_tl_window(spark, d):
    return tl.zoomed_in_once(tl.merge(_history(spark, d)))


FLAGSHIP = "ovw_orgs"
