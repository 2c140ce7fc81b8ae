"""Stores that heal themselves, and histories with racing appenders."""

from __future__ import annotations

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from watchpost import session
from watchpost.operators import timeline as tl
from watchpost.sources import store


@pytest.fixture()
def export(tmp_path):
    path = tmp_path / "github_dependencies_1.csv"
    rows = "".join(f"o{i % 3},r{i},package.json,dep{i},true\n" for i in range(300))
    path.write_text("org_name,repo_name,package_name,dependency_name,is_open_source\n" + rows)
    return str(path), str(tmp_path / "store")


def _files(root):
    return sorted(glob.glob(f"{root}/deps/fingerprint=*/version=*/*.parquet"))


def _damage(path, how):
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    data = open(path, "rb").read()
    if how == "missing":
        os.remove(path)
    elif how == "truncated":
        open(path, "wb").write(data[: len(data) // 2])
    elif how == "overwritten":
        open(path, "wb").write(b"x" * len(data))
    else:  # some bytes of the pages, with footer and size as they were
        open(path, "wb").write(data[:20] + bytes(b ^ 0x55 for b in data[20:60]) + data[60:])


@pytest.mark.parametrize("how, verify", [
    ("missing", "footers"), ("truncated", "footers"), ("overwritten", "footers"), ("garbled", "rows"),
])
def test_a_damaged_store_is_made_anew(spark, export, how, verify):
    path, root = export
    want = sorted(store.store(spark, path, root, "deps").collect())
    first = _files(root)
    assert sorted(store.store(spark, path, root, "deps", verify=verify).collect()) == want
    assert _files(root) == first  # whole: reused
    _damage(first[0], how)
    assert sorted(store.store(spark, path, root, "deps", verify=verify).collect()) == want
    again = _files(root)
    assert set(again) - set(first)  # a new version beside what is left of the old one
    assert sorted(store.store(spark, path, root, "deps", verify=verify).collect()) == want and _files(root) == again


def test_readers_of_an_old_version_are_not_disturbed(spark, export):
    path, root = export
    old = store.store(spark, path, root, "deps")
    want = sorted(old.collect())
    base = os.path.dirname(os.path.dirname(_files(root)[0]))
    store.publish(spark, old.limit(5), base, None)
    assert store.store(spark, path, root, "deps").count() == 5  # the last entry counts
    assert sorted(old.collect()) == want


def test_a_version_without_its_log_entry_does_not_exist(spark, export, monkeypatch):
    path, root = export
    monkeypatch.setattr(store, "claim_next", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.store(spark, path, root, "deps")
    monkeypatch.undo()
    assert store.store(spark, path, root, "deps").count() == 300


def test_a_file_is_claimed_once(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: session.claim(spark, f"{tmp_path}/log/1", f"by {i}"), range(24)))
    assert sum(made) == 1
    assert session.read_small(spark, f"{tmp_path}/log/1") == f"by {made.index(True)}"
    assert session.names(spark, f"{tmp_path}/log") == ["1"]


def _candidates(spark, keys, total):
    metrics = spark.createDataFrame([(total,)], "total long")
    out = None
    for key in keys:
        one = tl.from_metrics(metrics, "secrets", key)
        out = one if out is None else out.union(one)
    return out


def test_concurrent_appends_store_each_key_once(spark, tmp_path):
    path = f"{tmp_path}/history"
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda i: tl.append(spark, path, _candidates(spark, ["same", f"own{i}"], i)), range(4)))
    rows = tl.read_raw(spark, path).collect()
    assert sorted(r["fingerprint"] for r in rows) == ["own0", "own1", "own2", "own3", "same"]
    assert sorted(r["id"] for r in rows) == [1, 2, 3, 4, 5] and sorted(counts) == [1, 1, 1, 2]
    assert len(glob.glob(f"{path}/batch=*")) == 4  # the losers' batches are gone
    assert tl.append(spark, path, _candidates(spark, ["same"], 9)) == 0


def test_an_uncommitted_batch_is_never_read(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/history"
    tl.append(spark, path, _candidates(spark, ["a"], 1))
    monkeypatch.setattr(tl, "claim_next", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        tl.append(spark, path, _candidates(spark, ["b"], 1))
    monkeypatch.undo()
    assert [r["fingerprint"] for r in tl.read_raw(spark, path).collect()] == ["a"]
    assert tl.append(spark, path, _candidates(spark, ["b"], 1)) == 1
    assert sorted(r["id"] for r in tl.read_raw(spark, path).collect()) == [1, 2]
