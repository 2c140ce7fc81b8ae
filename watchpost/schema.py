"""Schemas, dataset bindings and the fixed values the operators share.

The three alert-like datasets share shapes (a filterable table with an org, a
repo, a few categorical columns and a free-text search), so every operator
is written once against a *binding*: a small record that maps the logical
role to the physical column name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Alert date columns repaired from text to timestamp on ingest.
ALERT_DATE_COLUMNS = ["Created_At", "Updated_At", "Dismissed_At", "Fixed_At", "Auto_Dismissed_At"]

# Alert columns shown in the paged table, in display order.
ALERT_DISPLAY_COLUMNS = [
    "Alert_Number", "Organization_Name", "Repository_Name", "State",
    "Severity", "Dependency_Package_Ecosystem", "Dependency_Package_Name",
    "CVE_ID", "CVSS_Score", "Advisory_Summary", "Created_At", "URL",
]

# Alert columns searched case-insensitively, in the order they are OR-ed.
ALERT_SEARCH_COLUMNS = [
    "Advisory_Summary", "CVE_ID", "Dependency_Package_Name",
    "Repository_Name", "Organization_Name",
]

# Dependency inventory columns, also the display columns, in order.
DEPS_COLUMNS = ["org_name", "repo_name", "package_name", "dependency_name", "is_open_source"]

# Dependency columns searched case-insensitively.
DEPS_SEARCH_COLUMNS = ["dependency_name", "repo_name", "package_name", "org_name"]

# Alert state / severity domains (case-sensitive comparisons).
ALERT_STATES = ["open", "fixed", "dismissed", "auto_dismissed"]
ALERT_SEVERITIES = ["critical", "high", "medium", "low"]

# Secret alert domains.
SECRET_STATES = ["open", "resolved"]
SECRET_VALIDITIES = ["active", "inactive", "unknown"]

# Text that counts as a true flag on secret alerts ("TRUE" does not).
TRUE_FLAG_TEXTS = ["True", "true"]

# Labels of the open-source breakdown.
OPEN_SOURCE_LABEL = "Open Source"
NOT_OPEN_SOURCE_LABEL = "Not Open Source"

# Snapshot history: metric columns, and the metric-key aliases of secrets.
SNAPSHOT_METRICS = [
    "total", "open", "critical", "high", "medium", "low",
    "fixed", "dismissed", "leaked", "bypassed", "orgs", "repos",
]
SNAPSHOT_KEY_ALIASES = {"leaked": "publicly_leaked", "bypassed": "push_bypassed"}
SNAPSHOT_SOURCES = ["dependabot", "secrets"]

# File-name globs that pick a dataset out of a drop folder.
DISCOVERY_GLOBS = {
    "alerts": "dependabot_alerts*.csv",
    "secrets": "secret_scanning*.csv",
    "deps": "github_dependencies*.csv",
}

# Paging and typeahead bounds.
PAGE_SIZE_MAX = 500
TYPEAHEAD_DEFAULT = 50
TYPEAHEAD_MAX = 200

# Link base for CVE ids.
CVE_LINK_BASE = "https://nvd.nist.gov/vuln/detail/"

# Display truncation of long text.
TRUNCATE_AT = 80
ELLIPSIS = "…"

# Top-k sizes of the breakdown charts.
TOP_ECOSYSTEMS = 10
TOP_ORGS = 20
TOP_MANIFESTS = 15
TOP_REPOS = 20
TOP_DEPENDENCIES = 20

# CVSS display bands: lower bounds of critical, high, medium (below: low).
CVSS_BAND_BOUNDS = [9.0, 7.0, 4.0]

# Org risk levels, in the order the rules are tried, and the share of the
# largest org total above which open volume alone makes an org Medium.
RISK_LABELS = ["Critical", "High", "None", "Medium", "Low"]
RISK_MEDIUM_SHARE = 0.25

# Heat map: number of cells, intensity = base + min(total/max, 1) * span,
# and the flat intensity of an empty map or a None-risk org.
HEAT_CELLS = 40
HEAT_BASE = 0.25
HEAT_SPAN = 0.65
HEAT_FLAT = 0.5

# Timeline zoom: share of the span trimmed per side on zoom-in, widened per
# side on zoom-out.
ZOOM_IN_SHARE = 0.25
ZOOM_OUT_SHARE = 0.5

# ---------------------------------------------------------------------------
# Design choices for the secrets dataset, whose defining code is absent.
# ---------------------------------------------------------------------------

SECRET_DISPLAY_COLUMNS = [
    "Alert_Number", "Organization_Name", "Repository_Name", "Secret_Type",
    "State", "Validity", "Publicly_Leaked", "Push_Protection_Bypassed",
    "Created_At", "URL",
]
SECRET_SEARCH_COLUMNS = ["Secret_Type", "Repository_Name", "Organization_Name"]
SECRET_DATE_COLUMNS = ["Created_At"]


@dataclass(frozen=True)
class Binding:
    """Logical roles of one dataset's columns."""

    name: str
    org: str
    repo: str
    display: list[str]
    search: list[str]
    # filter argument name -> column
    members: dict[str, str] = field(default_factory=dict)
    # leading columns of the page order; the other display columns follow
    page_order: list[str] = field(default_factory=list)
    state: str | None = None
    created: str | None = None


ALERTS = Binding(
    name="alerts",
    org="Organization_Name",
    repo="Repository_Name",
    display=ALERT_DISPLAY_COLUMNS,
    search=ALERT_SEARCH_COLUMNS,
    members={
        "severity": "Severity",
        "state": "State",
        "ecosystem": "Dependency_Package_Ecosystem",
        "org": "Organization_Name",
    },
    # The reference pages without ORDER BY (storage order); Spark has no
    # storage order, so paging is made deterministic on these keys.
    page_order=["Organization_Name", "Repository_Name", "Alert_Number"],
    state="State",
    created="Created_At",
)

SECRETS = Binding(
    name="secrets",
    org="Organization_Name",
    repo="Repository_Name",
    display=SECRET_DISPLAY_COLUMNS,
    search=SECRET_SEARCH_COLUMNS,
    members={
        "secret_type": "Secret_Type",
        "state": "State",
        "validity": "Validity",
        "org": "Organization_Name",
    },
    page_order=["Organization_Name", "Repository_Name", "Alert_Number"],
    state="State",
    created="Created_At",
)

DEPS = Binding(
    name="deps",
    org="org_name",
    repo="repo_name",
    display=DEPS_COLUMNS,
    search=DEPS_SEARCH_COLUMNS,
    members={
        "org": "org_name",
        "repo": "repo_name",
        "package_file": "package_name",
    },
    # The reference orders by org, repo, dependency; rows can repeat, so the
    # remaining display columns complete the order.
    page_order=["org_name", "repo_name", "dependency_name", "package_name", "is_open_source"],
)

# ---------------------------------------------------------------------------
# Struct types
# ---------------------------------------------------------------------------


def all_string(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


DEPS_SCHEMA = all_string(DEPS_COLUMNS)

SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("fingerprint", T.StringType(), False),
    ]
    + [T.StructField(m, T.LongType(), True) for m in SNAPSHOT_METRICS]
)
