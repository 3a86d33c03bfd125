"""Joins, running totals and products of sparse tables that no hot key brings into one task."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from relspark.lexicon import Lexicon
from relspark.operators import joins, senses as sn, vectors as vec
from relspark.plans import cache as store, measures as ms
from relspark.sources import tables


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_spread_join_is_a_left_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("4", None), ("7", 3), ("never", 4)], "k string, v int")
    assert rows(joins.join_spread(left, right, "k")) == rows(left.join(right, "k", "left").select("k", "id", "v"))
    named, other = left.withColumnRenamed("k", "_key"), right.withColumnRenamed("k", "_key").withColumnRenamed("v", "_salt")
    assert rows(joins.join_spread(named, other, "_key")) == rows(left.join(right, "k", "left").select("k", "id", "v"))
    assert joins.join_spread(left.limit(0), right, "k").count() == 0
    assert rows(joins.join_spread(left, right.limit(0), "k")) == rows(left.select("k", "id", F.lit(None).cast("int")))


def test_running_total(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(x), int(n)) for x, n in zip(rng.permutation(500), rng.integers(0, 9, 500))] + [(None, 3)], "x double, n long")
    order = [F.desc_nulls_last("x")]
    expected = df.withColumn("t", F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = joins.running_total(df, F.col("n"), order, "t")
    assert rows(got) == rows(expected)
    assert rows(joins.running_total(df.limit(0), F.col("n"), order, "t")) == Counter()


def test_ranks_with_a_hot_score_and_without_scores(spark):
    scores = [0.0] * 700 + [None] * 300 + [float(k % 50) for k in range(500)] + [-0.001, 0.004]
    got = sn.rank_pairs(spark.createDataFrame([(str(i), "b", s) for i, s in enumerate(scores)], "w1 string, w2 string, score double")).collect()
    two = [None if s is None else round(s, 2) + 0.0 for s in scores]
    above = lambda s: sum(t is not None and (s is None or t > s) for t in two)
    want = {s: above(s) + 1 for s in set(two)}
    assert {int(r["w1"]): r["rank"] for r in got} == {i: want[s] for i, s in enumerate(two)}


@pytest.mark.parametrize("pack_cells", [3, 1 << 18])
def test_context_vectors_of_frequent_and_rare_words(spark, pack_cells):
    """Texts of some words that nearly all hold, and of many that few hold."""
    texts = [(k, w) for k in range(1500) for w in ("the", "of", "the", f"w{k}", f"w{k // 2}")] + [(None, "the"), (7, None)]
    vectors = [(w, f"d{i}", float(i + len(w))) for w in ("the", "of", *(f"w{k}" for k in range(0, 1500, 3))) for i in range(5 if w in ("the", "of") else 2)]
    t, v = spark.createDataFrame(texts, "key long, word string"), spark.createDataFrame(vectors, "word string, dim string, cnt double")
    stop = spark.createDataFrame([("of",)], "word string")
    for s in (None, stop):
        kinds = t.distinct() if s is None else t.distinct().where("word <> 'of' or word is null")
        expected = kinds.join(v, "word").groupBy("key", "dim").agg(F.sum("cnt").alias("v"))
        assert rows(vec.context_vectors(t, v, s, pack_cells)) == rows(expected)


def test_vector_files_in_splits(spark, tmp_path):
    dims = spark.createDataFrame([(f"w{i:03}", i + 1, 2) for i in range(200)], "word string, tf long, df long")
    made = spark.createDataFrame([(f"w{i:03}", f"w{(i * k) % 200:03}", float(k)) for i in range(200) for k in (1, 3, 7)], "word string, dim string, cnt double").groupBy("word", "dim").agg(F.sum("cnt").alias("cnt"))
    tables.write_vectors(str(tmp_path / "v"), 9, dims, made)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        n, dims2, made2 = tables.read_vectors(spark, str(tmp_path / "v"))
        number = {f"w{i:03}": i for i in range(200)}
        assert n == 9 and {(r["word"], r["dim"], r["tf"], r["df"]) for r in dims2.collect()} == {(w, i, i + 1, 2) for w, i in number.items()}
        assert {(r["word"], r["dim"], r["cnt"]) for r in made2.collect()} == {(r["word"], number[r["dim"]], r["cnt"]) for r in made.collect()}
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    (tmp_path / "bad").write_text("DOCUMENTCOUNT=3\n-VECTORS-\n-DIMENSIONS-\n")
    with pytest.raises(tables.FormatError):
        tables.read_vectors(spark, str(tmp_path / "bad"))


def test_scores_are_kept(spark, tmp_path):
    """A second run scores only new pairs; another measure, lexicon or option has a table of its own; old runs go."""
    asked = []

    @ms.measure("counting", sn.ALL_POS)
    def counting(lexicon, pairs, config):
        asked.append(sorted((r["a"], r["b"]) for r in pairs.collect()))
        return pairs.select(*ms.KEYS, (F.col("a") * 100.0 + F.col("b") + config.max_random).alias("score"))

    try:
        none = spark.createDataFrame([], "rel string, src_pos string, src long, dst_pos string, dst long, src_word string, dst_word string")
        made = lambda gloss: Lexicon(spark.createDataFrame([("n", 1, gloss, ["w"])], "pos string, id long, gloss string, words array<string>"), spark.createDataFrame([("w", "n", 1, 1, 1)], "word string, pos string, sense int, id long, word_no int"), none)
        pairs = lambda *ab: spark.createDataFrame([("n", a, "n", b, "extra") for a, b in ab], "pos_a string, a long, pos_b string, b long, score_of string")
        config = ms.Config(cache=store.ScoreCache(str(tmp_path)))
        run = lambda lexicon, config, *ab: sorted((r["a"], r["b"], r["score"], r["err_level"]) for r in ms.score(lexicon, pairs(*ab), "counting", config).collect())
        one = made("a gloss")
        assert run(one, config, (1, 2), (3, 4), (1, 2)) == [(1, 2, 103.0, 0), (1, 2, 103.0, 0), (3, 4, 305.0, 0)]
        assert run(one, config, (1, 2), (5, 6)) == [(1, 2, 103.0, 0), (5, 6, 507.0, 0)]
        assert run(one, config, (3, 4), (5, 6)) == [(3, 4, 305.0, 0), (5, 6, 507.0, 0)] and run(one, config) == []
        assert asked == [[(1, 2), (3, 4)], [(5, 6)]]
        run(made("another gloss"), config, (1, 2))
        run(one, ms.Config(cache=config.cache, max_random=2.0), (1, 2))
        assert asked[2:] == [[(1, 2)], [(1, 2)]]
        few = ms.Config(cache=store.ScoreCache(str(tmp_path), 1))
        assert run(one, few, (5, 6)) == [(5, 6, 507.0, 0)] and asked[4:] == []  # the first run's two pairs are gone, not the second's one
        assert run(one, few, (1, 2)) == [(1, 2, 103.0, 0)] and asked[4:] == [[(1, 2)]]
        unknown = spark.createDataFrame([("x", 1, "n", 2), (None, 1, "n", 2)], "pos_a string, a long, pos_b string, b long")
        assert ms.score(one, unknown, "counting", config).count() == 2
    finally:
        del ms.MEASURES["counting"]


def test_a_count_file_of_the_version_is_found(spark, tmp_path):
    for name, version in {"b.dat": "two", "a.dat": "one", "c.dat": "two", "note.txt": None}.items():
        (tmp_path / name).write_text((f"wnver::{version}\n" if version else "") + "5n 3\n")
    assert tables.find_counts(spark, str(tmp_path), "two").endswith("b.dat") and tables.find_counts(spark, str(tmp_path), None).endswith("a.dat")
    with pytest.raises(tables.FormatError):
        tables.find_counts(spark, str(tmp_path), "three")


def test_compounds_of_many_documents_are_not_broadcast(spark):
    from relspark.functions.compounds import compound_tokens

    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "key long, ws array<string>")
    made = compound_tokens(docs, spark.createDataFrame([("a_b",), ("b_c",)], "word string"), "key", "ws")
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2  # both of hot keys
    assert {tuple(r) for r in made.collect()} == {(1, 0, "a_b"), (1, 2, "c"), (2, 0, "x")}


def test_cooccurrence_sends_no_documents_to_the_driver(spark):
    from relspark.operators.vectors import cooccurrence

    made = cooccurrence(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], "doc long, word string"))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in made.collect()} == {("a", "a", 4), ("a", "b", 2), ("b", "a", 2), ("b", "b", 2)}
