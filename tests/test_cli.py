"""The command line answers the reference's requests as JSON lines."""

from __future__ import annotations

import json
import os

from watchpost.__main__ import main

HEADER = ("Alert_Number,Organization_Name,Repository_Name,State,Severity,Dependency_Package_Ecosystem,"
          "Dependency_Package_Name,CVE_ID,CVSS_Score,Advisory_Summary,Created_At,URL\n")


def run(capsys, *argv):
    capsys.readouterr()
    assert main(list(argv)) == 0
    return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.strip()]


def test_cli_flow(spark, tmp, capsys):
    os.makedirs(f"{tmp}/drop")
    with open(f"{tmp}/drop/dependabot_alerts_1.csv", "w") as f:
        f.write(HEADER + "1,acme,api,open,critical,npm,log4js,CVE-1,9.8,x,2024-01-02 03:04:05,u\n"
                         "2,acme,web,fixed,high,pip,django,CVE-2,7.5,y,2024-01-03,u\n")
    base = ["--dataset", "alerts", "--csv", f"{tmp}/drop", "--store", f"{tmp}/store"]
    out = run(capsys, "ingest", *base, "--summaries")
    assert out[0]["rows"] == 2 and len(out[0]["fingerprint"]) == 12
    assert run(capsys, "call", *base, "metrics")[0]["total"] == 2
    page = run(capsys, "call", *base, "page", "--filter", "state=open")
    assert page[0]["total"] == 1 and page[1]["Created_At"] == "2024-01-02T03:04:05"
    assert [r["org"] for r in run(capsys, "call", *base, "search_orgs", "--q", "AC")] == ["acme"]
    assert run(capsys, "overview", "--alerts-csv", f"{tmp}/drop", "--store", f"{tmp}/store", "risk")[0]["risk"] == "Critical"
    hist = run(capsys, "timeline", "--store", f"{tmp}/store")
    assert len(hist) == 1 and hist[0]["source"] == "dependabot"
    exp = run(capsys, "export", *base, "--out", f"{tmp}/out", "--filter", "severity=high")
    assert exp[0]["export"] == f"{tmp}/out"


def test_cli_seek_paging(spark, tmp, capsys):
    os.makedirs(f"{tmp}/drop")
    with open(f"{tmp}/drop/dependabot_alerts_1.csv", "w") as f:
        f.write(HEADER + "".join(f"{i},acme,api,open,high,npm,p,CVE-{i},5.0,x,2024-01-02,u\n" for i in range(1, 8)))
    base = ["--dataset", "alerts", "--csv", f"{tmp}/drop", "--store", f"{tmp}/store"]
    first = run(capsys, "call", *base, "page_after", "--page-size", "3")
    assert [r["Alert_Number"] for r in first] == [1, 2, 3]
    nxt = run(capsys, "call", *base, "page_after", "--page-size", "3", "--after", json.dumps(first[-1]))
    assert [r["Alert_Number"] for r in nxt] == [4, 5, 6]
