"""Words are scored by kinds of their concepts: as all pairs of senses give it, with few pairs scored."""

import pytest
from pyspark.sql import functions as F

from relspark.lexicon import Lexicon
from relspark.operators import senses as sn
from relspark.plans import measures as ms


@pytest.fixture(scope="module")
def lexicon(spark):
    # 1 is above 2 and 3; 20 to 29 are leaves of 2, 30 to 34 of 2 and 3; 4 is a leaf of no parents, 5 one of 3.
    isa = [("n", 2, 1), ("n", 3, 1), ("n", 5, 3)] + [("n", i, 2) for i in [*range(20, 30), *range(30, 35)]] + [("n", i, 3) for i in range(30, 35)]
    words = {"x": list(range(20, 30)), "y": [5, *range(30, 35)], "z": [29, 2, 4], "t": [24, 31], "s": [24]}
    senses = [(w, "n", k + 1, i, 1) for w, ids in words.items() for k, i in enumerate(ids)]
    nodes = sorted({i for _, c, p in isa for i in (c, p)} | {4})
    synset = spark.createDataFrame([("n", i, "g", [str(i)]) for i in nodes], "pos string, id long, gloss string, words array<string>")
    sense = spark.createDataFrame(senses, "word string, pos string, sense int, id long, word_no int")
    taxonomy = spark.createDataFrame(isa, "pos string, child long, parent long")
    return Lexicon(synset, sense, None, None, taxonomy)


@pytest.mark.parametrize("name, root", [("path", True), ("lch", False)])
def test_words_by_kinds_equal_all_pairs(spark, lexicon, name, root, monkeypatch):
    pairs = spark.createDataFrame([(a, b) for a in "xyzts" for b in "xyzts"], "w1 string, w2 string")
    config = ms.Config(root_node=root)
    senses = sn.lookup(pairs.select(F.col("w1").alias("input")), lexicon.sense, None, ("n", "v"))
    whole = ms.score(lexicon, sn.sense_pairs(pairs, senses), name, config).localCheckpoint()
    plain = lambda rows: sorted(tuple(r[c] if c != "score" or r[c] is None else round(r[c], 9) for c in ("w1", "w2", "wps1", "wps2", "score")) for r in rows.collect())
    asked, score = [], ms.score
    monkeypatch.setattr(ms, "score", lambda lexicon, rows, *a: asked.append(rows.select(*ms.KEYS).distinct().count()) or score(lexicon, rows, *a))
    assert plain(ms.score_words(lexicon, pairs, name, config, all_senses=True)) == plain(whole)
    assert plain(ms.score_words(lexicon, pairs, name, config)) == plain(sn.best_sense(whole.where("err_level = 0")))
    assert max(asked) < whole.select(*ms.KEYS).distinct().count() / 3


def test_senses_come_last(spark, lexicon, monkeypatch):
    """Rows meet the lists of senses by one join a side, and are not moved after; long lists are of several rows."""
    monkeypatch.setattr(ms, "SENSES_A_ROW", 4, raising=False)
    pairs = spark.createDataFrame([(a, b) for a in "xyz" for b in "xyz"], "w1 string, w2 string")
    made = ms.score_words(lexicon, pairs, "path", all_senses=True)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2
    assert made.count() == (10 + 6 + 3) ** 2 and made.select("wps1", "wps2").distinct().count() == made.count()
    ids = {(r["wps1"], r["a"]) for r in made.where("wps1 like 'x%'").select("wps1", "a").distinct().collect()}
    assert ids == {(f"x#n#{k + 1}", 20 + k) for k in range(10)}
