"""CSV sources and sinks, discovery, fingerprint and the Parquet store."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from watchpost.operators import timeline as tl
from watchpost.sources import csv as src
from watchpost.sources import export, store, views

HEADER = ("Alert_Number,Organization_Name,Repository_Name,State,Severity,"
          "Dependency_Package_Ecosystem,Dependency_Package_Name,CVE_ID,CVSS_Score,"
          "Advisory_Summary,Created_At,URL,Extra_Col\n")


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_alerts_csv_dialect(spark, tmp):
    body = (
        '1,acme,r1,open,high,npm,"left,pad",CVE-1,7.5,"He said ""hi""",2024-01-02 03:04:05,u,x\n'
        '2,acme,r2,fixed,low,npm,p,,n/a,"two\nlines",not a date,,y\n'
        '3,,r3,open,critical,pip,p,CVE-3,NA,s,2024-01-03,,\n'
    )
    p = f"{tmp}/dependabot_alerts.csv"
    write(p, HEADER + body)
    df = src.alerts(spark, p)
    rows = {r["Alert_Number"]: r for r in df.collect()}
    assert set(rows) == {1, 2, 3} and df.count() == 3
    assert "Extra_Col" in df.columns  # extra columns kept
    assert rows[1]["Dependency_Package_Name"] == "left,pad"
    assert rows[1]["Advisory_Summary"] == 'He said "hi"'
    assert rows[2]["Advisory_Summary"] == "two\nlines"
    assert rows[2]["Created_At"] is None and rows[2]["CVE_ID"] is None
    assert rows[3]["Organization_Name"] is None and rows[3]["CVSS_Score"] == "NA"
    assert dict(df.dtypes)["Created_At"] == "timestamp"


def test_malformed_rows_dropped_consistently(spark, tmp):
    body = "1,a,r,open,high,npm,p,c,1,s,2024-01-01,u,x\n2,a,r,open\n3,a,r,open,high,npm,p,c,1,s,2024-01-01,u,x,EXTRA,MORE\n"
    p = f"{tmp}/bad.csv"
    write(p, HEADER + body)
    df = src.alerts(spark, p)
    assert df.count() == len(df.collect()) == df.select("State").count()


def test_deps_csv_empty_to_null_and_na_text(spark, tmp):
    p = f"{tmp}/github_dependencies_x.csv"
    write(p, "org_name,repo_name,package_name,dependency_name,is_open_source\n"
             'o,r,package.json,react,true\no,,requirements.txt,NA,""\no,r,pom.xml,null,False\n')
    rows = src.deps(spark, p).orderBy("package_name").collect()
    assert [r["repo_name"] for r in rows] == ["r", "r", None]
    assert [r["dependency_name"] for r in rows] == ["react", "null", "NA"]
    assert rows[2]["is_open_source"] is None


def test_export_round_trip(spark, tmp):
    a = views.alerts(spark, SF_SMALL)
    path = export.alerts(a, f"{tmp}/out", state=["open"], search="urgent")
    back = src.alerts(spark, path)
    want = a.where((F.col("State") == "open") & F.lower("Advisory_Summary").contains("urgent"))
    assert sorted(back.columns) == sorted(a.columns)
    assert back.exceptAll(want.select(back.columns)).count() == 0
    assert want.select(back.columns).exceptAll(back).count() == 0


def test_discover_first_alphabetical(spark, tmp):
    write(f"{tmp}/drop/dependabot_alerts_z.csv", HEADER + "1,a,r,open,high,npm,p,c,1,s,2024-01-01,u,x\n")
    write(f"{tmp}/drop/dependabot_alerts_b.csv", HEADER + "2,a,r,open,high,npm,p,c,1,s,2024-01-01,u,x\n")
    write(f"{tmp}/drop/secret_scanning.csv", "x\n1\n")
    write(f"{tmp}/drop/notes.txt", "x")
    assert src.discover(spark, f"{tmp}/drop", "alerts").endswith("/dependabot_alerts_b.csv")
    assert src.discover(spark, f"{tmp}/drop", "secrets").endswith("/secret_scanning.csv")
    assert src.discover(spark, f"{tmp}/drop", "deps") is None
    assert src.discover(spark, f"{tmp}/nowhere", "deps") is None


def test_fingerprint_tracks_file_state(spark, tmp):
    p = f"{tmp}/dependabot_alerts.csv"
    write(p, HEADER + "1,a,r,open,high,npm,p,c,1,s,2024-01-01,u,x\n")
    first = store.fingerprint(spark, p)
    assert len(first) == 12 and first == store.fingerprint(spark, p)
    time.sleep(1.1)
    write(p, HEADER + "1,a,r,open,high,npm,p,c,1,s,2024-01-01,u,x\n2,a,r,open,high,npm,p,c,1,s,2024-01-01,u,x\n")
    assert store.fingerprint(spark, p) != first


def test_store_reuses_parse_and_records_snapshot_once(spark, tmp):
    p = f"{tmp}/dependabot_alerts.csv"
    write(p, HEADER + "1,a,r,open,critical,npm,p,c,9.1,s,2024-01-01,u,x\n2,b,r,fixed,low,npm,p,,n/a,s,,u,x\n")
    root = f"{tmp}/store"
    df1 = store.store(spark, p, root, "alerts")
    fp = store.fingerprint(spark, p)
    target = f"{root}/alerts/fingerprint={fp}"
    stamp = sorted(os.path.getmtime(os.path.join(target, f)) for f in os.listdir(target))
    df2 = store.store(spark, p, root, "alerts")
    assert stamp == sorted(os.path.getmtime(os.path.join(target, f)) for f in os.listdir(target))
    assert df1.count() == df2.count() == 2
    hist = tl.read_history(spark, tl.store_path(root)).collect()
    assert len(hist) == 1 and hist[0]["source"] == "dependabot" and hist[0]["critical"] == 1
    assert hist[0]["fingerprint"] == fp and hist[0]["total"] == 2


def test_summaries_equal_live_results(spark, tmp):
    from watchpost.plans import summaries as summ
    frames = {"alerts": views.alerts(spark, SF_SMALL), "secrets": views.secrets(spark, SF_SMALL),
              "deps": views.dependencies(spark, SF_SMALL)}
    for dataset, df in frames.items():
        built = summ.build(spark, df, f"{tmp}/root", dataset, "fp0")
        assert sorted(built) == sorted(summ.SUMMARIES[dataset])
        assert summ.build(spark, df, f"{tmp}/root", dataset, "fp0") == []  # reused
        for name, fn in summ.SUMMARIES[dataset].items():
            live = [tuple(r) for r in fn(df).collect()]
            stored = [tuple(r) for r in summ.read(spark, f"{tmp}/root", dataset, "fp0", name).collect()]
            assert stored == live, (dataset, name)


def test_store_builds_summaries_on_request(spark, tmp):
    from watchpost.plans import summaries as summ
    p = f"{tmp}/dependabot_alerts.csv"
    write(p, HEADER + "1,a,r,open,critical,npm,p,c,9.1,s,2024-01-01,u,x\n2,b,r,fixed,low,npm,p,,n/a,s,,u,x\n")
    root = f"{tmp}/store"
    df = store.store(spark, p, root, "alerts", record_snapshot=False, summaries=True)
    fp = store.fingerprint(spark, p)
    for name in summ.SUMMARIES["alerts"]:
        assert summ.present(spark, summ.location(root, "alerts", fp, name)), name
    assert summ.read(spark, root, "alerts", fp, "metrics").first()["total"] == df.count() == 2


def test_export_keeps_blanks_around_text(spark, tmp):
    df = spark.createDataFrame([("  lead", "tail  ", "p", " both ", None)],
                               "org_name string, repo_name string, package_name string, dependency_name string, "
                               "is_open_source string")
    back = src.deps(spark, export.write_csv(df, f"{tmp}/out"))
    assert [tuple(r) for r in back.select(df.columns).collect()] == [tuple(r) for r in df.collect()]


def test_columns_come_by_each_files_header(spark, tmp):
    write(f"{tmp}/in/a.csv", "State,Severity,Alert_Number\nopen,high,1\n")
    write(f"{tmp}/in/b.csv", "Severity,State,Alert_Number,Extra\nlow,fixed,2,x\n")
    write(f"{tmp}/in/c.csv", "")
    got = {r["Alert_Number"]: (r["State"], r["Severity"], r["Extra"]) for r in src.alerts(spark, f"{tmp}/in").collect()}
    assert got == {1: ("open", "high", None), 2: ("fixed", "low", "x")}
    write(f"{tmp}/d.csv", "dependency_name,org_name,added\nNA,o,1\n")
    assert [r.asDict() for r in src.deps(spark, f"{tmp}/d.csv").collect()] == [
        {"dependency_name": "NA", "org_name": "o", "added": "1"}]


def test_discovery_takes_underscores_literally(spark, tmp):
    write(f"{tmp}/dependabot-alerts.csv", "x\n")
    write(f"{tmp}/deeper/dependabot_alerts_0.csv", "x\n")
    assert src.discover(spark, tmp, "alerts") is None
    write(f"{tmp}/dependabot_alerts.csv", "x\n")
    assert src.discover(spark, tmp, "alerts") == f"{tmp}/dependabot_alerts.csv"


def test_half_written_store_is_made_again(spark, tmp):
    p = f"{tmp}/dependabot_alerts.csv"
    write(p, HEADER + "1,a,r,open,critical,npm,p,c,9.1,s,2024-01-01,u,x\n2,b,r,fixed,low,npm,p,,n/a,s,,u,x\n")
    root = f"{tmp}/store"
    df = store.store(spark, p, root, "alerts", record_snapshot=False)
    target = f"{root}/alerts/fingerprint={store.fingerprint(spark, p)}"
    df.limit(1).write.mode("overwrite").parquet(target)
    os.remove(f"{target}/_SUCCESS")  # as a killed job leaves it
    assert store.store(spark, p, root, "alerts", record_snapshot=False).count() == 2


def test_damaged_history_is_not_taken_for_an_empty_one(spark, tmp):
    import pytest
    write(f"{tmp}/hist/source=secrets/part-0.parquet", "not parquet")
    with pytest.raises(Exception):
        tl.read_raw(spark, f"{tmp}/hist").collect()
    assert tl.read_raw(spark, f"{tmp}/none").count() == 0
