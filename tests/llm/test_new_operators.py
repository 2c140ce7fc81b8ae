"""Collocations, hard negatives and MinHash against plain versions, and on the defined odd cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import rows
from watchpost.llm import decontaminate, lines, minhash, negatives, phrases, simhash, tokenfile, tokens

# 11 collocations


def _listed(frame):
    return sorted(map(tuple, frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def _prose(seed: int, many: int) -> list[tuple[str | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "the", "THE", "x y"]
    out: list[tuple[str | None, str | None]] = [(None, None), ("und", "of course of course."), ("a b%20", ""), (None, "Of course")]
    for _ in range(many):
        words = rng.choices(vocabulary, k=rng.randrange(1, 60))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", " ; "]) for w in words)
        out.append((rng.choice(["en", None, "a b%20", "de", "de"]), text))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_collocations_match_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(phrases, "_TOGETHER", 300)  # the sums are added up in many steps
    data = _prose(order, 150)
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "doc_id long, lang string, text string")
    got = _listed(phrases.collocations(frame.repartition(5), order=order, least=4))
    assert got == brute.collocations(data, order, 4)
    assert {r[0] for r in got} >= {"en", "de", "und", "a b%20"}


def test_collocations_of_the_odd_texts(documents, empty, clashing):
    got = _listed(phrases.collocations(documents, least=3))
    assert got == brute.collocations([("en", t) for _, t in rows()], 3, 3)
    assert _listed(phrases.collocations(empty)) == []
    texts = [("en", r["text"]) for r in clashing.collect()]
    assert _listed(phrases.collocations(clashing, least=2)) == brute.collocations(texts, 3, 2)


def test_hot_pairs_are_dealt_by_their_last_word_and_still_counted(spark, monkeypatch):
    """A pair that makes up most windows, with ever other followers."""
    monkeypatch.setattr(phrases, "_BYTES", 2_000)
    data = [("en", " ".join(f"so on n{i}x{j}" for j in range(20))) for i in range(60)] + [("en", "so on so on so on")] * 15
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "doc_id long, lang string, text string")
    assert _listed(phrases.collocations(frame.repartition(6))) == brute.collocations(data)


def test_only_the_first_phrases_of_a_lang_are_returned(spark):
    data = [("en", f"a{i} b{i}. " * (10 + i % 3)) for i in range(40)] + [("fr", "c d " * 30)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "doc_id long, lang string, text string")
    assert _listed(phrases.collocations(frame, top=7)) == brute.collocations(data, top=7)


def test_scores_beyond_64_bits_are_exact(spark, monkeypatch):
    big = 3_000_000_019
    table = [("en", 0, "", 9 * big), ("en", 1, "x", big + 5), ("en", 1, "y", big + 11), ("en", 2, "x y", big)]
    monkeypatch.setattr(
        phrases, "grams", lambda *_: spark.createDataFrame(table, "lang string, size int, phrase string, f long")
    )
    got = _listed(phrases.collocations(spark.createDataFrame([], "lang string, text string")))
    assert got == [("en", 1, "x y", big, big + 5, big + 11, 9 * big, 1000000 * big * big // ((big + 5) * (big + 11)))]


# 12 hard negatives

VECTORS = "vec_id long, label int, embedding array<float>"


def _mined(frame, **more):
    got = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, **more)
    return sorted(map(tuple, got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def _vectors(seed: int, many: int, width: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    data = centres[rng.integers(0, 6, many)] + rng.normal(size=(many, width)) * 0.7
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    return [(i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]


@pytest.mark.parametrize("width", [3, 20])
def test_hard_negatives_match_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(negatives, "_BLOCK", 90)
    monkeypatch.setattr(negatives, "_ASK", 7)
    data = _vectors(width, 400, width)
    assert _mined(spark.createDataFrame(data, VECTORS)) == brute.hard_negatives(data, lambda i: i % 10 == 0)


def test_hard_negatives_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = _vectors(1, 60, 4) + [
        (None, 1, [1.0, 0.0, 0.0, 0.0]), (100, None, [1.0, 0.0, 0.0, 0.0]), (110, 1, None), (120, 1, [1.0, None]),
        (130, 1, [nan, 0.0]), (140, 2, [inf, 0.0]), (150, 2, []), (160, 1, [0.5]), (171, 3, [0.0] * 4), (180, 3, [0.0] * 4),
        (10, 0, [0.1, 0.2, 0.3, 0.4]), (33, 2, [0.9, 0.1, 0.1, 0.1]), (33, 2, [0.9, 0.1, 0.1, 0.1]),
        (190, 1, [-1.0, -1.0, -1.0, -1.0]), (201, 0, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]),
    ]
    frame = spark.createDataFrame(data, VECTORS).withColumn("block", F.lit(1)).withColumn("window", F.lit(2))
    assert _mined(frame) == brute.hard_negatives(data, lambda i: i % 10 == 0)
    assert _mined(spark.createDataFrame([], VECTORS)) == []


def test_one_very_common_vector_fills_windows_by_id(spark, monkeypatch):
    monkeypatch.setattr(negatives, "_BLOCK", 50)
    data = _vectors(2, 60, 5) + [(i, i % 4, [0.5, 0.5, 0.5, 0.5, 0.1]) for i in range(60, 300)]
    assert _mined(spark.createDataFrame(data, VECTORS)) == brute.hard_negatives(data, lambda i: i % 10 == 0)


def test_pairs_above_a_threshold_are_all_found():
    rng = np.random.default_rng(3)
    for width in (1, 7, 40):
        rows_, asks = (rng.integers(-200, 200, (n, width)) * rng.random((n, width)).round() for n in (300, 20))
        exact = rows_.astype(np.int64) @ asks.astype(np.int64).T
        least = np.quantile(exact, 0.97, axis=0)
        least[:2] = -np.inf, 0.0
        got = {(r, a): s for x in negatives.above(rows_.astype(np.int64), asks.astype(np.int64), least) for r, a, s in zip(*x)}
        assert got == {(r, a): exact[r, a] for r, a in zip(*np.nonzero(exact >= least))}


def test_large_components_stay_exact_or_raise(spark):
    data = [(i, i % 2, [300_000.0 + i, 200_000.0 - 3 * i]) for i in range(30)]
    assert _mined(spark.createDataFrame(data, VECTORS.replace("float", "double"))) == brute.hard_negatives(
        data, lambda i: i % 10 == 0
    )
    with pytest.raises(Exception, match="64 bits"):
        _mined(spark.createDataFrame([(0, 1, [1e300])], VECTORS.replace("float", "double")))


# 13 MinHash


def _classes(frame, **more):
    got = minhash.near_duplicates(frame, **more)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()}


def test_minhash_matches_brute_force(documents):
    assert _classes(documents) == brute.minhash(rows())


def _copies(seed: int) -> list[tuple[int, str]]:
    """Groups of copies whose similarities lie around the least one."""
    rng = random.Random(seed)
    out = []
    for group in range(12):
        base = [f"g{group}t{i}" for i in range(rng.choice([4, 12, 60, 150]))]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 8))):
                words[rng.randrange(len(words))] = f"e{rng.random()}"
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("piece", [10**6, 200])
def test_minhash_finds_all_links_between_near_copies(spark, piece, monkeypatch):
    """Buckets cut into many slices must lose no link."""
    monkeypatch.setattr(minhash, "_SLICE", piece)
    data = _copies(4)
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert _classes(frame.repartition(4)) == brute.minhash(data)


def test_links_that_no_star_tells_are_found(spark):
    """Copies that each differ from the base, but are too far from each other."""
    base = [f"t{i}" for i in range(100)]
    data = [(0, " ".join(base))]
    for k in range(1, 30):
        words = list(base)
        for at in range(3 * k, 3 * k + 10, 2):
            words[at % 100] = f"e{k}x{at}"
        data.append((k, " ".join(words)))
    assert {c for _, c in brute.minhash(data).values()} == {0}
    assert _classes(spark.createDataFrame(data, "doc_id long, text string")) == brute.minhash(data)


def test_buckets_agree_as_often_as_sets_do():
    """Share of equal buckets against similarity to the power of the rows of a band, small sets included."""
    rng = random.Random(9)
    for n, other in ((5, 1), (9, 1), (90, 10), (400, 60)):
        share = []
        for _ in range(60):
            common = {f"{rng.random()}".encode() for _ in range(n - other)}
            a, b = (common | {f"{rng.random()}".encode() for _ in range(other)} for _ in range(2))
            share.append(float(np.mean(minhash.buckets(a) == minhash.buckets(b))))
        similar = (n - other) / (n + other)
        assert abs(np.mean(share) - similar ** minhash._ROWS) < 0.1


def test_minhash_odd_tables(spark, empty, clashing):
    assert minhash.near_duplicates(empty).collect() == []
    got = minhash.near_duplicates(clashing)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    found = sorted(((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in got.collect()), key=str)
    assert found == sorted([
        (1, True, 1), (1, True, 1), (1, True, 1), (None, True, 1), (None, False, None), (2, False, 2), (3, True, 3),
        (3, False, 3),
    ], key=str)
    with pytest.raises(ValueError):
        minhash.near_duplicates(clashing, percent=70)


# Earlier operators: bounds, ids and names

def test_items_with_one_opening_line_up_in_bounded_slices(spark, monkeypatch):
    """Many items that begin alike against a text that repeats the beginning."""
    monkeypatch.setattr(decontaminate, "_ALIGNMENTS", 50)
    opening = "which of the old bridges over the wide river was built"
    items = [(f"q{i}", f"{opening} by mason number {i} of the town") for i in range(40)]
    texts = [(0, f"{opening} " * 60), (1, f"so {opening} by mason number 7 of the town hall"), (2, "nothing here")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(
        items, "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert got[0]["item_ids"] == sorted(f"q{i}" for i in range(40)) and got[0]["longest_match"] == 11
    assert got[1]["longest_match"] == 18 and len(got[1]["item_ids"]) == 40 and got[2]["item_ids"] == []
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [2]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 900)
    again = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert {d: tuple(r) for d, r in got.items()} == {d: tuple(r) for d, r in again.items()}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [2]


def test_slices_tell_the_same_runs_as_one(monkeypatch):
    rng = random.Random(8)
    vocabulary = "a b c".split()
    test = decontaminate.TestSuffixes(
        [([str(i)], " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for i in range(30)], 4)
    texts = [[w.encode() for w in rng.choices(vocabulary + ["z"], k=rng.randrange(0, 80))] for _ in range(25)]
    whole = decontaminate._judge(texts, test)
    for limit in (1, 7, 100):
        monkeypatch.setattr(decontaminate, "_ALIGNMENTS", limit)
        assert decontaminate._judge(texts, test) == whole
    assert decontaminate._any(texts, test).tolist() == [bool(r[3]) for r in whole]


def test_columns_named_like_those_of_the_operators(clashing):
    names = ["__lines", "__site", "__kept", "__doc_id", "__tie"]
    frame = clashing.select("doc_id", "text", "source", *[F.col("n_chars").alias(n) for n in names])
    kept = lines.drop_boilerplate(frame)
    assert kept.columns == [*frame.columns, "__n_lines", "__n_dropped"] and kept.count() == 8
    assert simhash.keep_first(frame).columns == frame.columns
    assert simhash.keep_first(frame).count() == simhash.keep_first(clashing).count()


def test_rows_without_an_id_are_dealt_to_all_shards(spark, tmp_path):
    rows_ = [(None if i % 2 else i, f"text number {i}") for i in range(400)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string")
    tokenfile.write(frame, str(tmp_path / "t"), tokens.public("byte_bpe_50k.json"), 2)
    found = tokenfile.documents(tokenfile.read(spark, str(tmp_path / "t"))).collect()
    assert len(found) == 400 and sum(r["doc_id"] is None for r in found) == 200
    ends = {r["start"] + r["n_tokens"] for r in found}
    assert len({r["start"] for r in found}) == 400 and {r["start"] for r in found} - ends == {0}
    shards = tokenfile.read(spark, str(tmp_path / "t")).groupBy("shard").agg(
        F.sum(F.size("doc_ids")).alias("n")).collect() if "doc_ids" in tokenfile.read(spark, str(tmp_path / "t")).columns else []
    assert all(r["n"] < 300 for r in shards)
