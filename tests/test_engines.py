"""The request-level facade composes the operators as the reference's routes do."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from watchpost.operators import metrics as met
from watchpost.plans.engines import AlertsEngine, DepsEngine, Overview, SecretsEngine, Timeline
from watchpost.sources import csv as src
from watchpost.sources import views


def test_alerts_engine_round_trip(spark, tmp):
    eng = AlertsEngine(views.alerts(spark, SF_SMALL))
    page = eng.page(2, 25, state=["open"], search="urgent")
    env = page.envelope.first()
    rows = page.rows.collect()
    assert env["total"] == eng.df.where((F.col("State") == "open")
                                        & F.lower("Advisory_Summary").contains("urgent")).count()
    assert len(rows) == min(25, max(0, env["total"] - 25))
    assert eng.metrics().first()["total"] == eng.df.count()
    assert {r["option"] for r in eng.filter_options().collect()} == {"severities", "states", "ecosystems"}
    assert len(eng.agg_org().collect()) <= 20 and len(eng.agg_ecosystem().collect()) <= 10
    assert all(r["org"] for r in eng.search_orgs("nation").collect())
    path = eng.export(f"{tmp}/out", severity=["critical"])
    assert src.alerts(spark, path).count() == eng.df.where(F.col("Severity") == "critical").count()


def test_other_engines(spark, tmp):
    d = DepsEngine(views.dependencies(spark, SF_SMALL))
    assert d.page(1, 10, is_open_source="true").rows.count() <= 10
    assert d.search_repos("", 3).count() == 3
    assert d.agg_open_source().agg(F.sum("count")).first()[0] == d.df.count()
    s = SecretsEngine(views.secrets(spark, SF_SMALL))
    assert s.metrics().first()["total"] == s.df.count()
    assert s.agg_validity().count() == 3
    o = Overview(views.alerts(spark, SF_SMALL), None)
    assert o.totals().first()["sec_total"] == 0
    assert o.rank().first()["rank"] == 1
    t = Timeline(spark, f"{tmp}/hist")
    assert t.record(met.secrets(s.df), "secrets", "fp1") == 1
    assert t.record(met.secrets(s.df), "secrets", "fp1") == 0
    got = t.get("secrets").collect()
    assert len(got) == 1 and got[0]["total"] == s.df.count()
    assert t.merged().count() == 1


def test_engines_serve_stored_summaries(spark, tmp):
    from watchpost.plans import summaries as summ
    df = views.alerts(spark, SF_SMALL)
    summ.build(spark, df, f"{tmp}/root", "alerts", "fpX")
    live = AlertsEngine(df)
    stored = AlertsEngine(df, summaries=(f"{tmp}/root", "fpX"))
    for call in ("metrics", "agg_severity", "agg_org", "agg_trend", "filter_options"):
        assert [tuple(r) for r in getattr(stored, call)().collect()] == \
            [tuple(r) for r in getattr(live, call)().collect()], call
    # a summary that was never built falls back to the live computation
    other = AlertsEngine(df, summaries=(f"{tmp}/root", "missing"))
    assert other.metrics().first()["total"] == df.count()


def test_typeahead_and_overview_from_summaries(spark, tmp):
    from watchpost.plans import summaries as summ
    a, s = views.alerts(spark, SF_SMALL), views.secrets(spark, SF_SMALL)
    d = views.dependencies(spark, SF_SMALL)
    summ.build(spark, a, f"{tmp}/r", "alerts", "fa")
    summ.build(spark, d, f"{tmp}/r", "deps", "fd")
    for q, n in [("ation_1", 50), ("  ", 3), ("NATION", 200)]:
        assert [r[0] for r in AlertsEngine(a, summaries=(f"{tmp}/r", "fa")).search_orgs(q, n).collect()] == \
            [r[0] for r in AlertsEngine(a).search_orgs(q, n).collect()]
    assert [r[0] for r in DepsEngine(d, summaries=(f"{tmp}/r", "fd")).search_repos("#0000000", 7).collect()] == \
        [r[0] for r in DepsEngine(d).search_repos("#0000000", 7).collect()]
    assert summ.build_overview(spark, a, s, f"{tmp}/r", "fa", "fs") is True
    assert summ.build_overview(spark, a, s, f"{tmp}/r", "fa", "fs") is False
    stored = Overview(a, s, stored=(f"{tmp}/r", "fa", "fs"))
    live = Overview(a, s)
    for call in ("orgs", "totals", "risk", "heat", "rank"):
        assert [tuple(r) for r in getattr(stored, call)().collect()] == \
            [tuple(r) for r in getattr(live, call)().collect()], call


def test_engine_seek_paging_matches_offset_pages(spark):
    import pytest
    a = AlertsEngine(views.alerts(spark, SF_SMALL))
    last, seen = None, []
    for p in range(1, 4):
        by_offset = [tuple(r) for r in a.page(p, 40, state=["open"]).rows.collect()]
        page = a.page_after(last, 40, state=["open"]).collect()
        assert [tuple(r) for r in page] == by_offset
        if page:
            last = page[-1].asDict()
        seen += page
    assert len(seen) == min(120, a.page(1, 40, state=["open"]).envelope.first()["total"])
    with pytest.raises(ValueError):
        a.page_after(["only", "part"], 40)
