"""Edge frames: NULLs, flag spelling, bad dates, NaN scores, empty tables,
ties at the top-k border, LIKE metacharacters, pages past the end, one
source missing."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from watchpost.functions import clean, scalar
from watchpost.operators import breakdowns as bd
from watchpost.operators import filters as flt
from watchpost.operators import metrics as met
from watchpost.operators import options as opt
from watchpost.operators import overview as ovw
from watchpost.operators import paging as pg
from watchpost.schema import ALERTS, DEPS

ALERT_SCHEMA = (
    "Alert_Number long, Organization_Name string, Repository_Name string, State string, "
    "Severity string, Dependency_Package_Ecosystem string, Dependency_Package_Name string, "
    "CVE_ID string, CVSS_Score string, Advisory_Summary string, Created_At timestamp"
)
SECRET_SCHEMA = (
    "Alert_Number long, Organization_Name string, Repository_Name string, Secret_Type string, "
    "State string, Validity string, Publicly_Leaked string, Push_Protection_Bypassed string, "
    "Created_At timestamp"
)
DEPS_SCHEMA = ("org_name string, repo_name string, package_name string, dependency_name string, "
               "is_open_source string")
T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def alert(n, org="acme", repo="r1", state="open", sev="high", eco="npm", pkg="left-pad",
          cve="CVE-1", cvss="5.0", summary="s", created=T0):
    return (n, org, repo, state, sev, eco, pkg, cve, cvss, summary, created)


def secret(n, org="acme", repo="r1", typ="token", state="open", validity="active",
           leaked="False", bypassed=None, created=T0):
    return (n, org, repo, typ, state, validity, leaked, bypassed, created)


def test_flag_text_spelling(spark):
    df = spark.createDataFrame([("True",), ("true",), ("TRUE",), (None,), ("false",)], "f string")
    got = [r[0] for r in df.select(scalar.flag_text("f")).collect()]
    assert got == [True, True, False, False, False]


def test_search_metacharacters(spark):
    rows = [("a%b",), ("a_b",), ("axb",), ("a\\b",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    hits = lambda q: sorted((r[0] for r in df.where(flt.search_predicate(q, ["v"])).collect()), key=str)
    # % and _ stay wildcards, as in the reference
    assert hits("a%b") == ["a%b", "a\\b", "a_b", "axb"]
    assert hits("a_b") == ["a%b", "a\\b", "a_b", "axb"]
    # a backslash stands for itself (no escape character), also at the end
    assert hits("\\") == ["a\\b"]
    assert hits("a\\") == ["a\\b"]
    # case-insensitive; NULL reads as '' and matches only the empty pattern
    assert hits("AXB") == ["axb"]
    assert len(hits("")) == 5


def test_try_timestamp_bad_and_absent_columns(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05", "junk"), ("", None)], "Created_At string, Fixed_At string")
    out = clean.try_timestamp(df, ["Created_At", "Updated_At", "Fixed_At"])
    assert dict(out.dtypes) == {"Created_At": "timestamp", "Fixed_At": "timestamp"}
    rows = out.collect()
    assert rows[0]["Created_At"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert rows[0]["Fixed_At"] is None and rows[1]["Created_At"] is None


def test_safe_int_and_nonfinite(spark):
    df = spark.createDataFrame([("12.7",), ("-3.9",), ("abc",), (None,), ("NaN",), ("Infinity",)], "v string")
    got = [r[0] for r in df.select(clean.safe_int("v")).collect()]
    assert got == [0, 0, 0, 0, 0, 0]  # text that is no whole number
    d = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r[0] for r in clean.nonfinite_to_null(d).collect()] == [1.5, None, None, None]


def test_met_alerts_nan_average_is_null_and_empty_is_zero(spark):
    nan_rows = [alert(1, cvss="NaN"), alert(2, cvss="7.0")]
    m = met.alerts(spark.createDataFrame(nan_rows, ALERT_SCHEMA)).first()
    assert m["avg_cvss"] is None and m["total"] == 2
    empty = met.alerts(spark.createDataFrame([], ALERT_SCHEMA)).first().asDict()
    assert empty["total"] == 0 and empty["avg_cvss"] == 0.0 and empty["cves"] == 0
    none_scored = met.alerts(spark.createDataFrame([alert(1, cvss="n/a")], ALERT_SCHEMA)).first()
    assert none_scored["avg_cvss"] == 0.0


def test_met_alerts_counts(spark):
    rows = [alert(1, state="open", sev="critical"), alert(2, state="dismissed", sev="low", org=None),
            alert(3, state="auto_dismissed", sev=None, cve=None, repo="r2"),
            alert(4, state="fixed", sev="medium", cvss="9.25")]
    m = met.alerts(spark.createDataFrame(rows, ALERT_SCHEMA)).first().asDict()
    assert m == {"total": 4, "open": 1, "fixed": 1, "dismissed": 2, "critical": 1, "high": 0,
                 "medium": 1, "low": 1, "avg_cvss": round((5 + 5 + 5 + 9.25) / 4, 2),
                 "repos": 2, "orgs": 1, "cves": 1}


def test_three_valued_open_source(spark):
    rows = [("o", "r", "p", "a", "true"), ("o", "r", "p", "b", "TRUE"), ("o", "r", "p", "c", None),
            ("o", "r", "p", "d", "False")]
    df = spark.createDataFrame(rows, DEPS_SCHEMA)
    m = met.deps(df).first()
    assert (m["open_source"], m["not_open_source"]) == (2, 1)  # NULL skipped
    cats = {r["category"]: r["count"] for r in bd.deps_open_source(df).collect()}
    assert cats == {"Open Source": 2, "Not Open Source": 2}  # NULL counted as not
    # the filter compares exactly; '' is a real filter matching nothing
    assert flt.deps(df, is_open_source="true").count() == 1
    assert flt.deps(df, is_open_source="").count() == 0
    assert flt.deps(df, is_open_source=None).count() == 4


def test_top_k_ties_break_on_key(spark):
    rows = [alert(i, eco=e) for i, e in enumerate(["b", "a", "c", "d", "d", None, None])]
    df = spark.createDataFrame(rows, ALERT_SCHEMA)
    got = [(r["ecosystem"], r["count"]) for r in bd.count_by(df, "Dependency_Package_Ecosystem", "ecosystem", k=3).collect()]
    assert got == [("d", 2), (None, 2), ("a", 1)]


def test_page_past_end_and_envelope(spark):
    df = spark.createDataFrame([alert(i) for i in range(7)], ALERT_SCHEMA)
    assert pg.alerts(df, 5, 3).count() == 0
    env = pg.envelope(df, 5, 3).first().asDict()
    assert env == {"total": 7, "page": 5, "page_size": 3, "total_pages": 3, "first_row": 13, "last_row": 7}
    empty = pg.envelope(df.where(F.lit(False)), 1, 50).first()
    assert empty["total_pages"] == 1 and empty["last_row"] == 0
    with pytest.raises(ValueError):
        pg.alerts(df, 0, 10)
    with pytest.raises(ValueError):
        pg.alerts(df, 1, 501)


def test_page_orders_nulls_last_and_projects_display(spark):
    rows = [alert(3, org=None), alert(2, org="b"), alert(1, org="a", repo=None), alert(0, org="a")]
    df = spark.createDataFrame(rows, ALERT_SCHEMA).withColumn("Extra", F.lit(1))
    page = pg.alerts(df, 1, 10)
    assert "Extra" not in page.columns and "URL" not in page.columns
    assert [r["Alert_Number"] for r in page.collect()] == [0, 1, 2, 3]


def test_seek_paging_matches_offset_paging(spark):
    rows = [alert(i, org=[None, "a", "b"][i % 3], repo=[None, "r1", "r2", "r3"][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, ALERT_SCHEMA)
    cols = pg.order_names(df, ALERTS)
    last = None
    seen = []
    for page_no in range(1, 6):
        by_offset = [tuple(r[c] for c in cols) for r in pg.alerts(df, page_no, 9).collect()]
        by_seek = [tuple(r[c] for c in cols) for r in pg.page_after(df, ALERTS, last, 9).collect()]
        assert by_seek == by_offset
        if by_seek:
            last = list(by_seek[-1])
        seen += by_seek
    assert len(seen) == 40


def test_typeahead_blank_and_unstripped(spark):
    df = spark.createDataFrame([alert(i, org=o) for i, o in enumerate(["Acme", "acme corp", "Beta", None, "x acme"])], ALERT_SCHEMA)
    ta = lambda q, n=50: [r[0] for r in opt.typeahead(df, "Organization_Name", q, n).collect()]
    assert ta("   ", 2) == ["Acme", "Beta"]
    assert ta("ACME") == ["Acme", "acme corp", "x acme"]
    assert ta(" acme") == ["x acme"]  # the pattern keeps the space
    with pytest.raises(ValueError):
        ta("a", 201)


def test_options_sorted_distinct_non_null(spark):
    rows = [alert(1, sev="low", state="open"), alert(2, sev=None, state="open"), alert(3, sev="high", eco=None)]
    out = [(r[0], r[1]) for r in opt.alerts(spark.createDataFrame(rows, ALERT_SCHEMA)).collect()]
    assert out == [("ecosystems", "npm"), ("severities", "high"), ("severities", "low"), ("states", "open")]


def test_overview_one_source_missing(spark):
    a = spark.createDataFrame([alert(1, org="a"), alert(2, org="b", sev="critical"), alert(3, org=None)], ALERT_SCHEMA)
    s = spark.createDataFrame([secret(1, org="b", leaked="TRUE"), secret(2, org="c", leaked="True")], SECRET_SCHEMA)
    only_a = ovw.orgs(a, None).collect()
    assert [(r["org"], r["total_vulns"], r["sec_total"]) for r in only_a] == [("a", 1, 0), ("b", 1, 0)]
    only_s = ovw.totals(None, s).first().asDict()
    assert only_s["dep_total"] == 0 and only_s["sec_total"] == 2 and only_s["leaked"] == 1
    both = {r["org"]: r.asDict() for r in ovw.risk(ovw.orgs(a, s)).collect()}
    assert both["b"]["risk"] == "Critical" and both["c"]["risk"] == "Critical"
    assert both["a"]["risk"] == "High"  # severity high in the default alert
    t = ovw.totals(a, s).first()
    assert t["orgs"] == 3 and t["total_vulns"] == 5
    assert t["open_pct"] == 100.0


def test_risk_levels_volume_rules(spark):
    board = spark.createDataFrame(
        [("big", 0, 0, 0, 0, 0, 0, 0, 0, 100, 10, 1), ("mid", 0, 0, 0, 0, 0, 0, 0, 0, 40, 25, 1),
         ("low", 0, 0, 0, 0, 0, 0, 0, 0, 30, 24, 1), ("none", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)],
        "org string, dep_total long, dep_open long, dep_critical long, dep_high long, sec_total long, "
        "sec_open long, sec_leaked long, sec_bypassed long, total_vulns long, total_open long, repos long")
    got = {r["org"]: r["risk"] for r in ovw.risk(board).collect()}
    assert got == {"big": "Low", "mid": "Medium", "low": "Low", "none": "None"}
    heat = {r["org"]: r["intensity"] for r in ovw.heat(board).collect()}
    assert heat["none"] == 0.5 and math.isclose(heat["big"], 0.9) and math.isclose(heat["mid"], 0.25 + 0.4 * 0.65)
    ranks = [(r["rank"], r["org"], r["bar"]) for r in ovw.rank(board).collect()]
    assert ranks == [(1, "big", 100.0), (2, "mid", 40.0), (3, "low", 30.0), (4, "none", 0.0)]


def test_share_sums_to_one(spark):
    df = spark.createDataFrame([alert(i, sev=s) for i, s in enumerate(["low", "low", "high", None])], ALERT_SCHEMA)
    rows = bd.share(bd.alert_severity(df)).collect()
    assert math.isclose(sum(r["share"] for r in rows), 1.0)
    assert {r["Severity"]: r["percent"] for r in rows} == {"low": 50, "high": 25, None: 25}


def test_trend_excludes_null_dates(spark):
    rows = [alert(1, created=T0), alert(2, created=T0 + dt.timedelta(hours=20)), alert(3, created=None)]
    got = [(r["date"], r["count"]) for r in bd.alert_trend(spark.createDataFrame(rows, ALERT_SCHEMA)).collect()]
    assert got == [("2024-01-01", 1), ("2024-01-02", 1)]


def test_scalar_display_helpers(spark):
    df = spark.createDataFrame([("x" * 81, "CVE-1", "9.0"), ("short", None, "n/a"), (None, "", "3.9")],
                               "t string, cve string, s string")
    rows = df.select(scalar.truncate("t").alias("t"), scalar.cve_link("cve").alias("l"),
                     scalar.cvss_band("s").alias("b")).collect()
    assert rows[0]["t"] == "x" * 80 + "…" and rows[1]["t"] == "short" and rows[2]["t"] == ""
    assert rows[0]["l"].endswith("/CVE-1") and rows[1]["l"] is None and rows[2]["l"] is None
    assert [r["b"] for r in rows] == ["critical", None, "low"]


def test_deliver_iso_text(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7, 179575), 1.0),
                                (dt.datetime(1995, 1, 1), float("nan"))], "ts timestamp, x double")
    got = [(r["ts"], r["x"]) for r in clean.deliver(df).collect()]
    assert got == [("2024-01-01T00:00:07.179575", 1.0), ("1995-01-01T00:00:00", None)]


def test_unknown_filter_argument_rejected(spark):
    df = spark.createDataFrame([], DEPS_SCHEMA)
    with pytest.raises(ValueError):
        flt.apply(df, DEPS, severity=["x"])


def test_pages_of_tied_keys_hold_every_row_once(spark):
    """Repeated alert numbers, pages on either side of row 10,000."""
    rows = [alert(i % 10, org="a", repo="r")[:-1] + (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 7919 % 11000),)
            for i in range(11_000)]
    df = spark.createDataFrame(rows, ALERT_SCHEMA).repartition(7)
    key = lambda rs: [tuple(r) for r in rs]
    pages = sum((key(pg.alerts(df, p, 500).collect()) for p in range(18, 24)), [])
    assert len(pages) == 11_000 - 17 * 500 == len(set(pages))
    everything = key(pg.alerts(df, 1, 500).collect()) + pages
    assert len(set(everything)) == len(everything)


def test_seek_paging_through_repeated_rows(spark):
    rows = [("o", "r", "p", "hot", "true")] * 23 + [("o", "r", "p", f"d{i:02d}", None) for i in range(9)]
    df = spark.createDataFrame(rows, DEPS_SCHEMA)
    last, repeats, seen = None, 1, []
    while True:
        page = [tuple(r) for r in pg.page_after(df, DEPS, last, 7, repeats).collect()]
        if not page:
            break
        seen += page
        cols = pg.order_names(df, DEPS)
        last = [dict(zip(df.columns, page[-1], strict=True))[c] for c in cols]
        repeats = seen.count(page[-1])
    assert sorted(seen, key=str) == sorted(rows, key=str)
    with pytest.raises(ValueError):
        pg.page_after(df, DEPS, ["o"], 7)


def test_safe_int_by_type(spark):
    got = spark.sql("""SELECT '12.7' a, '1e3' b, '1.5d' c, ' -7 ' d, '1_000' e, 12.7D f, -12.7D g, double('nan') h,
      9007199254740993L i, true j, cast('12.7' as decimal(5,2)) k, cast(null as string) l, '99999999999999999999' m""")
    row = got.select(*[clean.safe_int(c).alias(c) for c in got.columns]).first()
    assert tuple(row) == (0, 0, 0, -7, 1000, 12, -12, 0, 9007199254740993, 1, 12, 0, 0)


def test_dates_need_a_full_date(spark):
    df = spark.createDataFrame([("12:30:00",), ("2024",), ("2024-05",), ("2024-05-06",), ("2024-05-06 07:08:09",),
                                ("2024-05-06T07:08:09",), ("x",), (None,)], "Created_At string")
    got = [r[0] for r in clean.try_timestamp(df, ["Created_At"]).collect()]
    assert [g is None for g in got] == [True, True, True, False, False, False, True, True]
    doubles = spark.createDataFrame([("1.5d",), ("1.5F",), ("1.5",), ("1e3",), ("x",)], "s string")
    assert [r[0] for r in doubles.select(clean.try_double("s")).collect()] == [None, None, 1.5, 1000.0, None]
