"""Nearest neighbours and the n-gram join against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.llm import ann, ngram_join, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_neighbours(rows, asked, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in sorted({i for i, _ in asked}):
        v = np.array(dict(asked)[q], np.float64)
        score = (x * v).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((v * v).sum()))
        other = ids != q
        out[q] = sorted(zip((-score[other]).tolist(), ids[other].tolist()))[:k]
    return out


def recall(got, expected):
    hits = sum(len({i for _, i in best} & got.get(q, set())) for q, best in expected.items())
    return hits / max(1, sum(len(best) for best in expected.values()))


def test_neighbours(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.op2_nearest_neighbours(spark, SF).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    expected = brute_neighbours(rows, [r for r in rows if r[0] % 50 == 0])
    assert set(got.groupby("query_id").size()) == {5}
    assert recall(got.groupby("query_id").vec_id.agg(set).to_dict(), expected) >= 0.9
    exact = {(q, i): -s for q, best in brute_neighbours(rows, [r for r in rows if r[0] % 50 == 0], len(rows)).items() for s, i in best}
    for q, part in got.sort_values("rank").groupby("query_id"):
        assert part["rank"].tolist() == [1, 2, 3, 4, 5]
        assert part.score.tolist() == pytest.approx([exact[q, i] for i in part.vec_id], abs=1e-12)
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id))


def test_neighbours_at_scale(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12_000, 64)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(frame, F.col("vec_id") % 200 == 0, block=64)
    expected = brute_neighbours(rows, [r for r in rows if r[0] % 200 == 0])
    assert recall(got.toPandas().groupby("query_id").vec_id.agg(set).to_dict(), expected) >= 0.93
    two = ann.search(frame, F.col("vec_id") % 200 == 0, tables=8, hashes=2, probes=512)
    assert recall(two.toPandas().groupby("query_id").vec_id.agg(set).to_dict(), expected) >= 0.5


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [inf, 1.0]), (None, [1.0, 0.0]), (9, []), (3, [0.0, 1.0]), (11, [1.0, 2.0, 3.0])]
    rows += [(100 + i, [1.0, 1.0]) for i in range(50)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, query_id int")
    got = {q: p.sort_values("rank").vec_id.tolist() for q, p in ann.search(frame, F.col("vec_id").isin(0, 3, 4, 101, 149), probes=4).toPandas().groupby("query_id")}
    assert got[0] == [1, 2, 100, 101, 102] and got[101] == [100, 102, 103, 104, 105] and got[149] == [100, 101, 102, 103, 104]
    assert got[3][:5] == [100, 101, 102, 103, 104] and 4 not in got
    assert ann.search(frame.limit(0), F.lit(True)).collect() == []
    assert {r["vec_id"] for r in ann.search(frame.where("vec_id in (0, 3)"), F.col("vec_id") == 0, probes=4).collect()} == {3}


def test_neighbours_are_complete(spark):
    rng = np.random.default_rng(1)

    def check(x, asked):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(asked)).toPandas()
        expected = brute_neighbours(rows, [rows[q] for q in asked])
        found = {q: part.sort_values("rank").vec_id.tolist() for q, part in got.groupby("query_id")}
        assert found == {q: [i for _, i in best] for q, best in expected.items()}

    # Tables of hardly more rows than a result.
    for n in (3, 6, 10):
        check(rng.normal(size=(n, 64)), list(range(n)))
    # Tight clusters, and queries far from them.
    for n_clusters in (3, 30):
        tight = rng.normal(size=(n_clusters, 64))[rng.integers(0, n_clusters, 3_000)] + 0.05 * rng.normal(size=(3_000, 64))
        check(np.vstack([tight, rng.normal(size=(40, 64))]), list(range(3_000, 3_040)))


def test_neighbours_keep_ties(spark):
    # Vectors of one direction but other lengths are entries of their own, all equally near.
    rows = [(i, [2.0 ** (40 - i), 0.0]) for i in range(40)] + [(100, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-12:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, least.get(find(i)), links[i]) for i, (d, _) in enumerate(rows)), key=lambda r: tuple((x is not None, x) for x in r))


def result(frame, **options):
    return sorted((tuple(r) for r in ngram_join.classes(frame, **options).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_join_on_documents(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    expected = brute_classes([tuple(r) for r in frame.collect()])
    got = result(frame)
    assert sum(e[2] > 0 for e in expected) > 50
    assert got == expected


def variants(rng, base, n):
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.choice(len(base), rng.integers(0, 4), replace=False):
            words[at] = f"x{rng.integers(1 << 30)}"
        out.append(" ".join(words))
    return out


def test_join_of_large_groups(spark, monkeypatch):
    """Groups of near copies beyond a bucket, beyond a block, and a passage that many share."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 64)
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 30, n)]
    texts = variants(rng, word(120), 230) + variants(rng, word(90), 40) + variants(rng, word(300), 3)
    passage = word(40)
    texts += [" ".join(word(60) + passage + word(60)) for _ in range(150)]
    texts += ["same text of the very same words"] * 30 + ["", None, "", "one", "One", "two words", "!!"]
    rows = [(None if i % 97 == 5 else int(i), t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, entry int").repartition(7)
    assert result(frame, small=24) == brute_classes(rows)
    kept = ngram_join.keep_one(frame.withColumn("_row", frame.doc_id).withColumn("doc", frame.text), small=24).drop("_row", "doc")
    assert kept.columns == frame.columns
    expected = brute_classes(rows)
    assert kept.count() == len({c for _, c, _ in expected if c is not None}) + sum(c is None for _, c, _ in expected)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(300):
        base = [f"w{i}" for i in rng.integers(0, 1 << 30, 204)]
        other = list(base)
        for at in (20, 60, 100, 140):  # 200 shingles, 20 of them others: 180 / 220 = 0.818
            other[at] = f"x{rng.integers(1 << 30)}"
        texts += [" ".join(base), " ".join(other)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sum(n for _, _, n in result(frame)) / 2
    assert found >= 0.97 * 300


def test_connect_long_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 150), (150, 170), (5, 5)]
    got = {r["node"]: r["root"] for r in ngram_join.connect(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 150, 170: 150}


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.classes(frame).collect() == [] and ngram_join.keep_one(frame).collect() == []
