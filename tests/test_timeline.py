"""Snapshot history: idempotent append, id sequence, merge, zoom, streaming."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from watchpost.operators import metrics as met
from watchpost.operators import timeline as tl
from watchpost.schema import SNAPSHOT_METRICS
from watchpost.sources import views
from watchpost.streaming import ingest

CAND = "timestamp timestamp, source string, fingerprint string, " + ", ".join(
    f"{m} long" for m in SNAPSHOT_METRICS)


def cand(ts, source, fp, total=1, **kw):
    vals = {m: 0 for m in SNAPSHOT_METRICS}
    vals.update(total=total, **kw)
    return (ts, source, fp, *[vals[m] for m in SNAPSHOT_METRICS])


def test_append_is_idempotent_and_ids_continue(spark, tmp):
    path = f"{tmp}/hist"
    t = dt.datetime(2024, 3, 1, 12, 0, 0)
    c1 = spark.createDataFrame([cand(t, "dependabot", "a"), cand(t, "secrets", "a")], CAND)
    assert tl.append(spark, path, c1) == 2
    assert tl.append(spark, path, c1) == 0  # same keys: nothing new
    c2 = spark.createDataFrame([cand(t + dt.timedelta(minutes=1), "dependabot", "b"),
                                cand(t + dt.timedelta(minutes=2), "dependabot", "b", total=9),
                                cand(t, "secrets", "a", total=5)], CAND)
    assert tl.append(spark, path, c2) == 1
    rows = tl.read_history(spark, path).orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3]
    assert [(r["source"], r["fingerprint"], r["total"]) for r in rows] == [
        ("dependabot", "a", 1), ("secrets", "a", 1), ("dependabot", "b", 1)]


def test_read_hides_id_and_fingerprint(spark):
    h = tl.appended(tl.empty_history(spark), spark.createDataFrame(
        [cand(dt.datetime(2024, 3, 1, 12, 0, 0, 5), "secrets", "x")], CAND))
    r = tl.read(h).first().asDict()
    assert "id" not in r and "fingerprint" not in r and r["timestamp"] == "2024-03-01T12:00:00.000005"
    assert tl.read(h, source="dependabot").count() == 0


def test_merge_last_wins_and_unknown_source_bucket(spark):
    t = dt.datetime(2024, 3, 1, 12, 0, 0)
    c = spark.createDataFrame([
        cand(t, "dependabot", "a", total=1),
        cand(t + dt.timedelta(seconds=30), "dependabot", "b", total=2),
        cand(t + dt.timedelta(seconds=10), "secrets", "s", total=7, leaked=3),
        cand(t + dt.timedelta(minutes=5), "other", "o", total=99),
    ], CAND)
    merged = tl.merge(tl.appended(tl.empty_history(spark), c)).collect()
    assert [r["timestamp"] for r in merged] == ["2024-03-01T12:00", "2024-03-01T12:05"]
    assert (merged[0]["dep_total"], merged[0]["sec_total"], merged[0]["sec_leaked"]) == (2, 7, 3)
    assert all(merged[1][k] is None for k in merged[1].asDict() if k != "timestamp")


def test_zoom_arithmetic_and_window(spark):
    assert tl.zoom_in(0, 9) == (2, 7)
    assert tl.zoom_in(3, 4) == (3, 4)
    assert tl.zoom_out(2, 7, 10) == (0, 9)
    merged = spark.createDataFrame([(f"2024-01-01T00:{i:02d}", i) for i in range(10)], "timestamp string, v long")
    got = [r["v"] for r in tl.window(merged, 2, 7).collect()]
    assert got == [2, 3, 4, 5, 6, 7]
    assert [r["v"] for r in tl.zoomed_in_once(merged).collect()] == [2, 3, 4, 5, 6, 7]


def test_backfill_and_metric_aliases(spark):
    s = views.secrets(spark, SF_SMALL)
    now = dt.datetime(2024, 5, 10, 8, 0, 0)
    row = tl.backfill(met.secrets(s), "secrets", "seed", now=now).first()
    m = met.secrets(s).first()
    assert row["timestamp"] == now - dt.timedelta(days=3)
    assert row["leaked"] == m["publicly_leaked"] and row["bypassed"] == m["push_bypassed"]
    assert row["critical"] == 0 and row["total"] == m["total"]


def test_streaming_drop_folder_ingest(spark, tmp):
    drop = f"{tmp}/drop"
    os.makedirs(drop)
    header = ("Alert_Number,Organization_Name,Repository_Name,Secret_Type,State,Validity,"
              "Publicly_Leaked,Push_Protection_Bypassed,Created_At,URL\n")
    with open(f"{drop}/secret_scanning_1.csv", "w") as f:
        f.write(header + "1,a,r,token,open,active,True,,2024-01-01 00:00:00,u\n"
                         "2,b,r,key,resolved,unknown,TRUE,true,bad,u\n")
    with open(f"{drop}/ignore_me.csv", "w") as f:
        f.write(header + "3,a,r,token,open,active,True,,2024-01-01 00:00:00,u\n")
    root = f"{tmp}/store"
    q = ingest.start(spark, drop, "secrets", root, f"{tmp}/ckpt")
    q.awaitTermination(120)
    stored = ingest.read_store(spark, root, "secrets")
    assert sorted(r["Alert_Number"] for r in stored.collect()) == [1, 2]
    assert stored.where(F.col("Created_At").isNull()).count() == 1
    hist = tl.read_history(spark, tl.store_path(root)).collect()
    assert len(hist) == 1 and hist[0]["total"] == 2 and hist[0]["leaked"] == 1
    assert hist[0]["bypassed"] == 1
    # a second run over the same folder finds nothing new
    q2 = ingest.start(spark, drop, "secrets", root, f"{tmp}/ckpt")
    q2.awaitTermination(120)
    assert ingest.read_store(spark, root, "secrets").count() == 2
    assert tl.read_history(spark, tl.store_path(root)).count() == 1


def test_racing_appends_of_one_key_leave_one_row(spark, tmp):
    path = f"{tmp}/hist"
    t = dt.datetime(2024, 3, 1, 12, 0, 0)
    c = spark.createDataFrame([cand(t, "secrets", "k", total=4)], CAND)
    # two appenders that both checked the (empty) history before writing
    rows_a = tl.new_rows(tl.read_history(spark, path), c)
    rows_b = tl.new_rows(tl.read_history(spark, path), c)
    for rows in (rows_a, rows_b):
        rows.write.mode("append").partitionBy("source").parquet(path)
    h = tl.read_history(spark, path)
    assert h.count() == 1 and h.where(F.col("source") == "secrets").count() == 1
    assert tl.append(spark, path, c) == 0
    assert h.columns == ["id", "timestamp", "source", "fingerprint", *SNAPSHOT_METRICS]


def test_streaming_snapshots_are_incremental_and_exact(spark, tmp):
    from watchpost.operators import metrics as met
    drop = f"{tmp}/drop"
    os.makedirs(drop)
    header = ("Alert_Number,Organization_Name,Repository_Name,Secret_Type,State,Validity,"
              "Publicly_Leaked,Push_Protection_Bypassed,Created_At,URL\n")
    root, ckpt = f"{tmp}/store", f"{tmp}/ckpt"
    batches = [
        "1,a,r1,token,open,active,True,,2024-01-01 00:00:00,u\n2,b,r2,key,resolved,unknown,TRUE,true,bad,u\n",
        "3,a,r3,token,open,active,true,true,2024-01-02 00:00:00,u\n4,,r1,key,open,inactive,False,,2024-01-02 00:00:00,u\n",
        "5,c,r1,token,resolved,active,True,,2024-01-03 00:00:00,u\n",
    ]
    for i, body in enumerate(batches):
        with open(f"{drop}/secret_scanning_{i}.csv", "w") as f:
            f.write(header + body)
        ingest.start(spark, drop, "secrets", root, ckpt).awaitTermination(120)
        whole = met.secrets(ingest.read_store(spark, root, "secrets")).first()
        snap = tl.read_history(spark, tl.store_path(root)).orderBy(F.col("id").desc()).first()
        assert (snap["total"], snap["open"], snap["leaked"], snap["bypassed"], snap["orgs"], snap["repos"]) == (
            whole["total"], whole["open"], whole["publicly_leaked"], whole["push_bypassed"],
            whole["orgs"], whole["repos"]), i
    assert tl.read_history(spark, tl.store_path(root)).count() == 3


def test_replayed_epoch_does_not_double_count(spark, tmp):
    from watchpost.streaming.ingest import _record_epoch
    schema = ("Alert_Number long, Organization_Name string, Repository_Name string, Secret_Type string, "
              "State string, Validity string, Publicly_Leaked string, Push_Protection_Bypassed string")
    e0 = spark.createDataFrame([(1, "a", "r1", "t", "open", "active", "True", None)], schema)
    e1 = spark.createDataFrame([(2, "a", "r2", "t", "open", "active", "False", "true"),
                                (3, "b", "r2", "t", "resolved", "active", "true", None)], schema)
    state = f"{tmp}/state"
    _record_epoch(spark, state, "secrets", e0, 0)
    first = _record_epoch(spark, state, "secrets", e1, 1).first().asDict()
    replay = _record_epoch(spark, state, "secrets", e1, 1).first().asDict()
    assert first == replay == {"total": 3, "open": 2, "leaked": 2, "bypassed": 1, "orgs": 2, "repos": 2}


def test_streaming_deps_ingest_has_no_snapshot(spark, tmp):
    drop = f"{tmp}/drop"
    os.makedirs(drop)
    with open(f"{drop}/github_dependencies_1.csv", "w") as f:
        f.write("org_name,repo_name,package_name,dependency_name,is_open_source\n"
                "o,r,package.json,react,true\no,,pom.xml,NA,\n")
    root = f"{tmp}/store"
    ingest.start(spark, drop, "deps", root, f"{tmp}/ckpt").awaitTermination(120)
    rows = ingest.read_store(spark, root, "deps").orderBy("package_name").collect()
    assert rows[1]["repo_name"] is None and rows[1]["is_open_source"] is None
    assert rows[0]["dependency_name"] == "react" and rows[1]["dependency_name"] == "NA"
    assert tl.read_history(spark, tl.store_path(root)).count() == 0
