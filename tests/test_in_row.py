"""Measures that are scored in the pair's row, against those that join candidates."""

import random

from pyspark.sql import functions as F

from relspark.lexicon import Lexicon
from relspark.operators import information as info, paths as pt
from relspark.plans import measures as ms
from relspark.plans.cache import ScoreCache

ISA = "pos string, child long, parent long"


def layers(seed: int) -> list[tuple[str, int, int]]:
    """Links of three levels below the tops, with several parents each, some of them two levels above."""
    r, levels = random.Random(seed), [range(1, 4), range(10, 15), range(20, 27), range(40, 60)]
    return sorted({("n", c, r.choice(levels[max(0, k - (1 if r.random() < 0.8 else 2))])) for k in (1, 2, 3) for c in levels[k] for _ in range(r.randint(1, 3))})


def made(spark, seed=1):
    isa = layers(seed)
    ids = sorted({x for _, c, p in isa for x in (c, p)})
    r = random.Random(seed)
    nodes = spark.createDataFrame([("n", i) for i in ids], "pos string, id long")
    own = spark.createDataFrame([("n", i, float(r.randint(0, 9))) for i in ids if i >= 20], "pos string, id long, freq double")
    links = spark.createDataFrame(isa, ISA)
    pairs = spark.createDataFrame([("n", r.choice(ids), "n", r.choice(ids)) for _ in range(120)], "pos_a string, a long, pos_b string, b long")
    return Lexicon(nodes, nodes, links, 3, links), info.propagate(own, nodes, links, 3), pairs


def test_information_in_row(spark):
    for seed, root in ((1, True), (2, False)):
        lexicon, counts, pairs = made(spark, seed)
        plain = Lexicon(lexicon.synset, lexicon.sense, lexicon.edge, None, lexicon.taxonomy)
        config = ms.Config(counts=counts, root_node=root)
        key = lambda x: (x["a"], x["b"])
        one, two = (sorted(ms.informed(x, pairs.distinct(), config).select(*("a", "b", "subsumer", "freq_l", "freq_a", "freq_b", "root_freq"), F.round("ic_l", 9).alias("l")).collect(), key=key) for x in (lexicon, plain))
        assert one == two and len(one) > 20
        ways = pt.counted_ways(lexicon.isa, ms.row_ends(pairs), counts, 3, root)
        ties = pt.informed_in_row(pairs.distinct(), ways, info.root_frequency(counts), True)
        p = pairs.distinct().select(F.col("pos_a").alias("pos"), "a", "b")
        every = pt.lcs_by_ic(p, pt.root_paths(lexicon.isa, ms.ends(p), root, 3), info.information(counts))
        assert sorted(map(tuple, ties.select("a", "b", "subsumer").collect())) == sorted(map(tuple, every.select("a", "b", "subsumer").collect()))


def test_rows_come_back(spark):
    """Each row once, also equal ones, those of other parts of speech, and those without a concept."""
    lexicon, counts, pairs = made(spark)
    odd = spark.createDataFrame([("n", 40, "n", 41), ("n", 40, "n", 41), ("n", 40, "v", 41), ("n", None, "n", 41), ("n", 777, "n", 40), ("a", 1, "a", 1), (None, 1, "n", 40)], pairs.schema)
    for name, root in (("jcn", False), ("path", True)):
        rows = ms.score(lexicon, odd, name, ms.Config(counts=counts, root_node=root)).collect()
        assert len(rows) == 7
        twice = [r for r in rows if (r["pos_b"], r["a"], r["b"]) == ("n", 40, 41)]
        assert len(twice) == 2 and twice[0] == twice[1] and {r["err_level"] for r in rows if r["pos_b"] == "v"} == {1}
        assert [(r["score"], r["err_level"]) for r in rows if r["pos_a"] == "n" and r["a"] is None] == [(-1_000_000.0, 1)]


def test_a_pair_is_shuffled_twice(spark):
    """Once to each of its concepts: neither candidates nor scores are moved."""
    lexicon, counts, pairs = made(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("path", "res", "lin", "jcn"):
            plan = ms.score(lexicon, pairs, name, ms.Config(counts=counts))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= 5  # the fifth counts the roots
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_cache_moves_pairs_once(spark, tmp_path):
    """Pairs that are keys alone meet their scores without a further join, equal ones as often as they were asked for."""
    lexicon, counts, pairs = made(spark)
    config = ms.Config(cache=ScoreCache(str(tmp_path)))
    first = pairs.limit(20)
    ms.score(lexicon, first, "path", config)
    asked = pairs.unionByName(spark.range(2500).select(F.lit("n").alias("pos_a"), F.lit(40).cast("long").alias("a"), F.lit("n").alias("pos_b"), F.lit(41).cast("long").alias("b")))
    kept = ms.score(lexicon, asked, "path", config)
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.select("a", "b", "score", "err_level").collect()))
    assert rows(kept) == rows(ms.score(lexicon, asked, "path")) and kept.count() == 2620


def test_lch_in_row(spark):
    """As by all subsumers on shortest ways and the taxonomies' own depths; nothing of a pair is grouped after it."""
    from relspark.plans import provenance as pv

    for seed in (1,):
        lexicon, _, pairs = made(spark, seed)
        plain = Lexicon(lexicon.synset, lexicon.sense, lexicon.edge, None, lexicon.taxonomy)
        whole = pt.taxonomy_depths(lexicon.synset, lexicon.isa, True, 3).where("root = 0").select("pos", "depth").collect()
        assert pt.virtual_depth(lexicon.synset, lexicon.isa, 3).collect() == whole
        rows = lambda df, *c: sorted(map(tuple, df.select("a", "b", *c, F.round("score", 9)).collect()))
        assert rows(ms.score(lexicon, pairs, "lch").distinct(), "err_level") == rows(ms.score(plain, pairs.distinct(), "lch"), "err_level")
        told = pv.provenance(lexicon, pairs, "lch")
        assert rows(told, "subsumer", "len", "depth") == rows(pv.provenance(plain, pairs, "lch"), "subsumer", "len", "depth")
    for found in (ms.score(lexicon, pairs, "lch"), pv.provenance(lexicon, pairs, "lch")):
        above = found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)
        assert len(above) == 2 and "Aggregate" not in above[0]


def test_all_paths_by_sorting(spark, monkeypatch):
    """As pairs of paths compared one by one, also where few are compared at once and where links run in circles."""
    monkeypatch.setattr(pt, "PATH_PAIRS", 3, raising=False)
    lexicon, _, pairs = made(spark, 3)
    circle = spark.createDataFrame([("n", 1, 2), ("n", 2, 3), ("n", 3, 1), ("n", 4, 2), ("n", 5, 3)], ISA)
    few = spark.createDataFrame([("n", a, b) for a in range(1, 7) for b in range(1, 7)], "pos string, a long, b long")
    for isa, p, height in ((lexicon.isa, pairs.distinct().select(F.col("pos_a").alias("pos"), "a", "b"), 3), (circle, few, None)):
        paths = pt.materialize(pt.root_paths(isa, ms.ends(p), height is not None, height))
        rows = lambda df: sorted(map(str, df.select("pos", "a", "b", "subsumer", "len", "nodes").collect()))
        every = pt.all_paths(p, paths)
        assert rows(every) == rows(pt.meetings(p, paths, True).select("pos", "a", "b", F.inline("met"))) and len(rows(every)) > 20
    assert "transform(" not in every._jdf.queryExecution().optimizedPlan().toString()
