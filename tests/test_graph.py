"""Micro fixtures of the taxonomy with values worked by hand, and properties of random graphs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from relspark.lexicon import UNRELATED, Lexicon
from relspark.operators import information as info, paths as pt, walks
from relspark.plans import measures as ms, provenance as pv


def make(spark, edges, freq=None, nodes=None, extra=()):
    ids = sorted({x for e in edges for x in e[:2]} | set(nodes or ()))
    edge = spark.createDataFrame([("hype", "n", a, "n", b, None, None) for a, b in edges] + [(*e, None, None) for e in extra], "rel string, src_pos string, src long, dst_pos string, dst long, src_word string, dst_word string")
    synset = spark.createDataFrame([("n", i, f"concept {i}", [f"w{i}"]) for i in ids], "pos string, id long, gloss string, words array<string>")
    sense = spark.createDataFrame([(f"w{i}", "n", 1, i, 1) for i in ids], "word string, pos string, sense int, id long, word_no int")
    lexicon = Lexicon(synset, sense, edge)
    counts = None
    if freq is not None:
        own = spark.createDataFrame([("n", k, float(v)) for k, v in freq.items()], "pos string, id long, freq double")
        counts = info.propagate(own, synset, lexicon.isa)
    return lexicon, counts


def scores(spark, lexicon, pairs, name, config=None):
    frame = spark.createDataFrame([("n", a, "n", b) for a, b in pairs], "pos_a string, a long, pos_b string, b long")
    return {(r["a"], r["b"]): r for r in ms.score(lexicon, frame, name, config).collect()}


MF0 = [(2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 4), (7, 6)]
FREQ0 = {4: 2, 5: 3, 6: 1, 7: 4, 8: 2}
TABLE0 = {
    (4, 5): (1 / 3, 0.75, 0.575364, 0.433451, 0.664859, 1.203973), (7, 5): (0.25, 0.666667, 0.575364, 0.376022, 0.523686, math.log(10 / 4)), (7, 6): (0.5, 0.888889, 1.163151, 0.912474, 4.481420, math.log(5)),
    (4, 6): (0.2, 0.5, 0.133531, 0.124564, 0.532789, math.log(2)), (4, 4): (1, 1, 0.980829, 1, 1599.499948, 2.302585), (7, 8): (1 / 6, 0.285714, 0, 0, 0.288539, 0.510826),
}


def test_general(spark):
    lexicon, counts = make(spark, MF0, FREQ0, [8])
    freq = {r["id"]: r["freq"] for r in counts.collect()}
    assert freq == {7: 4, 4: 6, 5: 3, 2: 9, 6: 5, 3: 5, 1: 14, 8: 2}
    for k, name in enumerate(("path", "wup", "res", "lin", "jcn", "lch")):
        got = scores(spark, lexicon, TABLE0, name, ms.Config(counts=counts))
        assert {p: round(r["score"], 6) for p, r in got.items()} == pytest.approx({p: v[k] for p, v in TABLE0.items()}, abs=2e-6), name
        assert all(r["err_level"] == 0 for r in got.values())


def test_without_root_node(spark):
    lexicon, counts = make(spark, MF0, FREQ0, [8])
    config = ms.Config(root_node=False, counts=counts)
    got = scores(spark, lexicon, [(4, 5), (7, 8)], "lch", config)
    assert got[4, 5]["score"] == pytest.approx(math.log(8 / 3)) and got[7, 8]["score"] == UNRELATED and got[7, 8]["err_level"] == 1
    for name in ("path", "wup", "res", "lin", "jcn"):
        assert scores(spark, lexicon, [(7, 8)], name, config)[7, 8]["score"] == UNRELATED


def test_candidates_not_all_common_ancestors(spark):
    lexicon, counts = make(spark, [(2, 1), (3, 2), (4, 3), (5, 3), (6, 1)], {2: 4, 6: 4})
    for name in ("res", "lin", "jcn"):
        assert scores(spark, lexicon, [(4, 5)], name, ms.Config(counts=counts))[4, 5]["score"] == 0
    lexicon, counts = make(spark, [(2, 1), (3, 2), (4, 3), (4, 1), (5, 4), (6, 4)], {5: 1, 6: 1})
    got = [scores(spark, lexicon, [(5, 6)], m, ms.Config(counts=counts))[5, 6]["score"] for m in ("wup", "res", "lin", "jcn")]
    assert got == pytest.approx([0.75, 0.693147, 0.5, 0.721348], abs=1e-6)


def test_ways_count_not_concepts(spark):
    lexicon, counts = make(spark, [(2, 1), (3, 1), (4, 2), (4, 3)], {4: 1})
    assert {r["id"]: r["freq"] for r in counts.collect()}[1] == 2
    got = [scores(spark, lexicon, [(2, 3)], m, ms.Config(counts=counts))[2, 3]["score"] for m in ("path", "wup", "res", "jcn")]
    assert got == pytest.approx([1 / 3, 2 / 3, 0, 0.721348], abs=1e-6)


def test_order_of_depths(spark):
    up = [(i, i + 1) for i in range(1, 9)]  # nine nodes to one root
    other = [(1, 101)] + [(i, i + 1) for i in range(101, 109)]  # ten to another
    lexicon, _ = make(spark, up + other)
    paths = pt.root_paths(lexicon.isa, lexicon.synset.where("id = 1"), True)
    depth = {o: pt.synset_depth(paths, o, True).collect()[0]["depth"] for o in ("numeric", "lexical")}
    assert depth == {"numeric": 10, "lexical": 11}


def test_shortcut(spark):
    lexicon, counts = make(spark, [(2, 1), (3, 2), (4, 3), (5, 4), (5, 1), (6, 3)], {5: 2, 6: 1})
    got = [scores(spark, lexicon, [(5, 4)], m, ms.Config(counts=counts))[5, 4]["score"] for m in ("path", "wup", "res", "lin", "jcn")]
    assert got == pytest.approx([0.5, 0.909091, 0.916291, 1.0, 499.499833], abs=1e-6)


def test_cycles(spark):
    lexicon, _ = make(spark, [(1, 2), (2, 1), (1, 3), (10, 11), (11, 10)])
    got = {}
    for r in pt.root_paths(lexicon.isa, lexicon.synset, True).collect():
        got.setdefault(r["id"], []).append(r["path"])
    assert sorted(got[1]) == [[1, 2, 0], [1, 3, 0]]
    assert [2, 1, 3, 0] in got[2] and got[10] == [[10, 11, 0]] and got[11] == [[11, 10, 0]]
    with pytest.raises(ValueError):
        make(spark, [(1, 2), (2, 1)], {1: 1})


def test_trace(spark):
    lexicon, _ = make(spark, MF0)
    assert scores(spark, lexicon, [(7, 6)], "path", ms.Config(trace=True))[7, 6]["trace"] == "7>6 (2); 7>4>2>1>3>6 (6)"


def test_provenance(spark):
    """Every score can be worked out from its trace alone."""
    lexicon, counts = make(spark, MF0, FREQ0, [8])
    frame = spark.createDataFrame([("n", a, "n", b) for a, b in TABLE0], "pos_a string, a long, pos_b string, b long")
    rows = {m: {(r["a"], r["b"]): r for r in pv.provenance(lexicon, frame, m, ms.Config(counts=counts)).collect()} for m in ("path", "lch", "wup", "res", "lin", "jcn")}
    for k, name in enumerate(("path", "wup", "res", "lin", "jcn", "lch")):
        assert {p: r["score"] for p, r in rows[name].items()} == pytest.approx({p: v[k] for p, v in TABLE0.items()}, abs=2e-6), name
    for p, r in rows["wup"].items():
        assert 2 * r["depth"] / (2 * r["depth"] + r["la"] + r["lb"] - 2) == pytest.approx(TABLE0[p][1], abs=2e-6)
    for p, r in rows["lch"].items():
        assert math.log(2 * r["depth"] / r["len"]) == pytest.approx(TABLE0[p][5], abs=2e-6)
    for p, r in rows["res"].items():
        assert r["ic_l"] == pytest.approx(-math.log(r["freq_l"] / r["root_freq"]) if r["freq_l"] else 0) and r["score"] == pytest.approx(TABLE0[p][2], abs=2e-6)
    assert (rows["wup"][7, 6]["subsumer"], rows["wup"][4, 5]["subsumer"], rows["res"][7, 5]["subsumer"]) == (6, 2, 2)
    told = {m: scores(spark, lexicon, [(7, 6), (7, 8)], m, ms.Config(counts=counts, trace=True)) for m in ("wup", "lch", "lin")}
    assert told["wup"][7, 6]["trace"].splitlines()[1].startswith("subsumer 6, depth 4") and told["lch"][7, 6]["trace"].splitlines()[0].endswith("7>4>2>1>3>6 (6)")
    assert "root of 16.0" in told["lin"][7, 8]["trace"]
    with pytest.raises(ValueError):
        pv.provenance(lexicon, frame, "random")


def test_provenance_of_texts(spark):
    """lesk, vector and vector_pairs: phrases, products and words; an empty text and a concept without relations have zeros."""
    lexicon, _ = make(spark, MF0)
    gloss = {1: "a big red house on a hill", 2: "the big red house", 3: "hill", 4: "", 5: None, 6: "red red red"}
    known = spark.createDataFrame(list(gloss.items()), "id long, _g string")
    lexicon = Lexicon(lexicon.synset.join(known, "id", "left").select("pos", "id", F.col("_g").alias("gloss"), "words"), lexicon.sense, lexicon.edge)
    frame = spark.createDataFrame([("n", a, "n", b) for a, b in ((1, 2), (1, 3), (1, 4), (5, 2), (6, 1), (2, 2))], "pos_a string, a long, pos_b string, b long")
    vectors = spark.createDataFrame([("big", "x", 1), ("red", "x", 2), ("red", "y", 1), ("house", "y", 2), ("hill", "z", 3)], "word string, dim string, cnt long")
    config = ms.Config(vectors=vectors, relations=[(["glos"], ["glos"], 1.0), (["glos"], ["syns"], 0.5)], vector_relations=[["glos"]])
    lesk = pv.provenance(lexicon, frame, "lesk", config).collect()
    assert {(r["a"], r["b"]): r["phrases"] for r in lesk if r["rid"] == min(x["rid"] for x in lesk)} == {(1, 2): ["big red house"], (1, 3): ["hill"], (1, 4): [], (5, 2): [], (6, 1): ["red"], (2, 2): ["the big red house"]}
    total = {}
    for r in lesk:
        total[r["a"], r["b"]] = total.get((r["a"], r["b"]), 0) + r["weight"] * sum(len(p.split()) ** 2 for p in r["phrases"])
    assert total == {(r["a"], r["b"]): r["score"] for r in ms.score(lexicon, frame, "lesk", config).collect()}
    normal = ms.Config(relations=config.relations, normalize=True)
    each = pv.provenance(lexicon, frame, "lesk", normal).groupBy("a", "b").agg(F.sum("score").alias("s")).collect()
    assert {(r["a"], r["b"]): r["s"] for r in each} == pytest.approx({(r["a"], r["b"]): r["score"] for r in ms.score(lexicon, frame, "lesk", normal).collect()})
    one = {(r["a"], r["b"]): r for r in pv.provenance(lexicon, frame, "vector", config).collect()}
    assert one[1, 2]["words_a"] == ["big", "hill", "house", "red"] and (one[1, 2]["dot"], one[1, 2]["na"] ** 2) == pytest.approx((18, 27)) and one[1, 4]["words_b"] == []
    scored = {(r["a"], r["b"]): r["score"] for r in ms.score(lexicon, frame, "vector", config).collect()}
    assert {p: r["score"] for p, r in one.items()} == pytest.approx(scored) and scored[2, 2] == pytest.approx(1)
    both = pv.provenance(lexicon, frame, "vector_pairs", config).groupBy("a", "b").agg(F.avg("score").alias("s")).collect()
    assert {(r["a"], r["b"]): r["s"] for r in both} == pytest.approx({(r["a"], r["b"]): r["score"] for r in ms.score(lexicon, frame, "vector_pairs", config).collect()})
    told = {(r["a"], r["b"]): r["trace"] for r in ms.score(lexicon, frame, "lesk", ms.Config(relations=config.relations, trace=True)).collect()}
    assert "big red house" in told[1, 2]


def test_parts_of_speech(spark):
    lexicon, _ = make(spark, MF0)
    frame = spark.createDataFrame([("n", 4, "v", 4), ("a", 1, "a", 1), ("a", 1, "n", 1)], "pos_a string, a long, pos_b string, b long")
    got = [(r["score"], r["err_level"]) for r in ms.score(lexicon, frame, "path").collect()]
    assert got == [(UNRELATED, 1), (None, 1), (UNRELATED, 1)]
    with pytest.raises(ValueError):
        ms.score(lexicon, frame, "none")


def recursive_walk(links, state, n, turns, node, end):
    """The automaton link by link: the best score of a walk from node to end, or 0."""
    if node == end and n > 1:
        return 8 - n - turns
    if n >= 5:
        return 0
    moves = {0: {"U": (1, 0), "D": (2, 0), "H": (3, 0)}, 1: {"U": (1, 0), "D": (4, 1), "H": (5, 1)}, 2: {"D": (2, 0), "H": (6, 0)}, 3: {"D": (7, 0), "H": (3, 0)}, 4: {"D": (4, 1)}, 5: {"D": (4, 2), "H": (5, 1)}, 6: {"H": (6, 1)}, 7: {"D": (7, 1)}}
    return max((recursive_walk(links, *(moves[state][d][:1]), n + 1, moves[state][d][1], to, end) for d, to in links.get(node, ()) if d in moves[state]), default=0)


def test_walks(spark):
    rng = random.Random(7)
    for _ in range(3):
        rows = {(rng.choice("UDH"), rng.randrange(12), rng.randrange(12)) for _ in range(26)}
        links = {}
        for d, a, b in rows:
            links.setdefault(a, []).append((d, b))
        steps = spark.createDataFrame([(d, "n", a, "n", b) for d, a, b in rows], "dir string, src_pos string, src long, dst_pos string, dst long")
        pairs = spark.createDataFrame([("n", a, "n", b) for a in range(12) for b in range(12)], "pos_a string, a long, pos_b string, b long")
        got = {(r["a"], r["b"]): r["score"] for r in walks.medium_strong(pairs, steps).collect()}
        expected = {(a, b): recursive_walk(links, 0, 0, 0, a, b) for a in range(12) for b in range(12)}
        assert {p: s for p, s in expected.items() if s} == got
        told = {(r["a"], r["b"]): r["way"] for r in walks.best_walks(pairs, steps).collect()}
        assert told.keys() == got.keys()
        for (a, b), way in told.items():
            at = a
            for link in way:
                assert (link["dir"], at, link["id"]) in rows
                at = link["id"]
            assert at == b
        scored = walks.best_walks(pairs, steps).select("a", "b", walks.walk_score(F.col("way")).alias("s")).collect()
        assert {(r["a"], r["b"]): r["s"] for r in scored} == got


def test_walks_along_are_found_once(spark):
    """Forty wholes of the same three parts, which are in one chain: states grow with the wholes, not with wholes x chain."""
    chain = [(x, x + 1) for x in range(100, 120)]
    rows = [("H", a, b) for x, y in chain for a, b in ((x, y), (y, x))] + [r for w in range(40) for p in (102, 110, 117) for r in (("U", w, p), ("D", p, w))]
    steps = spark.createDataFrame([(d, "n", a, "n", b) for d, a, b in rows], "dir string, src_pos string, src long, dst_pos string, dst long")
    asked = [(w, p) for w in range(40) for p in (100, 102, 106, 119)] + [(w, w + 1) for w in range(39)] + [(110, 3), (105, 106), (105, 107)]
    pairs = spark.createDataFrame([("n", a, "n", b) for a, b in asked], "pos_a string, a long, pos_b string, b long")
    links = {}
    for d, a, b in rows:
        links.setdefault(a, []).append((d, b))
    got = {(r["a"], r["b"]): r["score"] for r in walks.medium_strong(pairs, steps).collect()}
    assert got == {(a, b): s for a, b in asked if (s := recursive_walk(links, 0, 0, 0, a, b))}
    found = walks.sides(walks.ends_of(pairs), steps)
    assert found.up.count() == 40 * 4 + 2  # the starts and the parts of wholes
    assert found.along.where("start = 102 * 4 + 1").select("start", "m", "n").distinct().count() == found.along.where("start = 102 * 4 + 1").count() < 30


def test_hso(spark):
    edges = [(2, 1), (3, 1), (4, 2)]
    extra = [("hypo", "n", b, "n", a) for a, b in edges] + [("sim", "n", 3, "n", 5), ("sim", "n", 5, "n", 3)]
    lexicon, _ = make(spark, edges, nodes=[5], extra=extra)
    words = {1: "one", 2: "two", 3: "three", 4: "four", 5: "five"}
    pairs = [(2, 3), (4, 3), (4, 2), (4, 1), (1, 4), (2, 1), (2, 5), (1, 5), (5, 1), (3, 5), (4, 4)]
    frame = spark.createDataFrame([("n", a, words[a], "n", b, words[b]) for a, b in pairs], "pos_a string, a long, word_a string, pos_b string, b long, word_b string")
    got = {(r["a"], r["b"]): r["score"] for r in ms.score(lexicon, frame, "hso").collect()}
    assert got == {(2, 3): 5, (4, 3): 4, (4, 2): 4, (4, 1): 6, (1, 4): 6, (2, 1): 0, (2, 5): 0, (1, 5): 6, (5, 1): 0, (3, 5): 16, (4, 4): 16}
    told = {(r["a"], r["b"]): r for r in pv.provenance(lexicon, frame, "hso").collect()}
    assert {p: r["score"] for p, r in told.items()} == got and told[4, 4]["kind"] == "1 same concept" and told[3, 5]["kind"] == "2 horizontal link" and told[2, 1]["kind"] == "6 none"
    lines = {(r["a"], r["b"]): r["trace"] for r in ms.score(lexicon, frame, "hso", ms.Config(trace=True)).collect()}
    assert lines[4, 3] == "walk: n#4 U n#2 U n#1 D n#3" and lines[2, 1] == "none"
    near = spark.createDataFrame([("n", 2, "private_school", "n", 1, "school"), ("n", 1, "school", "n", 2, "private_school")], frame.schema.simpleString()[7:-1].replace(":", " "))
    assert [r["score"] for r in ms.score(lexicon, near, "hso").collect()] == [16, 16]


def test_measures_are_symmetric_and_self_similar(spark):
    rng = random.Random(3)
    edges = [(i, p) for i in range(1, 30) for p in rng.sample(range(i), min(i, rng.choice([1, 1, 2])))]
    edges = [(a + 1, b + 1) for a, b in edges]
    lexicon, counts = make(spark, edges, {i: rng.randint(0, 3) for i in range(1, 31)})
    pairs = [(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(40)]
    for name in ("path", "wup", "lch", "res", "lin", "jcn", "random"):
        got = scores(spark, lexicon, pairs + [(b, a) for a, b in pairs] + [(i, i) for i in range(1, 31)], name, ms.Config(counts=counts))
        assert all(got[a, b]["score"] == pytest.approx(got[b, a]["score"]) for a, b in pairs), name
        if name in ("path", "wup"):
            assert all(got[i, i]["score"] == 1 for i in range(1, 31))


def test_information(spark):
    _, counts = make(spark, MF0, FREQ0, [8])
    rows = {r["id"]: r for r in info.information(counts).collect()}
    assert rows[0]["ic"] == 0 and rows[0]["prob"] == 1 and rows[8]["ic"] == pytest.approx(math.log(8))
    bad = counts.withColumn("freq", F.when(F.col("id") == 7, 100.0).otherwise(F.col("freq")))
    assert [(r["prob"], r["ic"], r["err_level"]) for r in info.information(bad).where("id = 7").collect()] == [(0, 0, 2)]


def test_a_chain_of_a_thousand_levels(spark):
    """By doubling: ten rounds. Every path ends in the root, every concept has what stands below it."""
    isa = spark.createDataFrame([("n", i + 1, i) for i in range(1000)], "pos string, child long, parent long")
    members = spark.createDataFrame([("n", 1000), ("n", 3), ("n", 0), ("n", 5000)], "pos string, id long")
    got = {r["id"]: r["path"] for r in pt.root_paths(isa, members, False).collect()}
    assert got == {1000: list(range(1000, -1, -1)), 3: [3, 2, 1, 0], 0: [0], 5000: [5000]}
    nodes = spark.createDataFrame([("n", i) for i in range(1001)], "pos string, id long")
    own = nodes.selectExpr("pos", "id", "1.0D as freq")
    assert {r["id"]: (r["freq"], r["is_root"]) for r in info.propagate(own, nodes, isa).collect()} == {i: (1001.0 - i, i == 0) for i in range(1001)}


def test_doubling_is_as_growing(spark):
    """Random links, without circles and with some: the paths of node by node, and frequencies of level by level."""
    rng = random.Random(5)
    for circles in (False, True):
        links = {(a, b) for a in range(1, 16) for b in range(1, 16) if (b < a or (circles and b == a + 1)) and rng.random() < 0.16}
        isa = spark.createDataFrame([("n", a, b) for a, b in sorted(links)], "pos string, child long, parent long")
        members = spark.createDataFrame([("n", i) for i in (3, 9, 14, 15)], "pos string, id long")
        rows = lambda df: sorted((r["id"], r["path"]) for r in df.collect())
        assert rows(pt.root_paths(isa, members, False)) == rows(pt.grown_paths(isa, members, None))
        nodes = spark.createDataFrame([("n", i) for i in range(1, 16)], "pos string, id long")
        own = nodes.selectExpr("pos", "id", "cast(id as double) as freq")
        if circles:
            with pytest.raises(ValueError):
                info.propagate(own, nodes, isa)
        else:
            assert sorted(info.propagate(own, nodes, isa).collect()) == sorted(info.propagate(own, nodes, isa, 15).collect())


def test_candidates_without_pairs_of_paths(spark):
    """Random links without circles: candidates, lengths and distances are those of every pair of paths."""
    rng = random.Random(11)
    pairs = spark.createDataFrame([("n", a, b) for a in range(1, 15) for b in range(1, 15)], "pos string, a long, b long")
    for share, root_node in ((0.12, True), (0.3, True), (0.3, False)):
        links = [("n", a, b) for a in range(1, 15) for b in range(1, a) if rng.random() < share]
        isa = spark.createDataFrame(links, "pos string, child long, parent long")
        members = spark.createDataFrame([("n", i) for i in range(1, 15)], "pos string, id long")
        paths = pt.root_paths(isa, members, root_node)
        ways = {}
        for r in paths.collect():
            ways.setdefault(r["id"], []).append(r["path"])
        found, short, near = set(), {}, {}
        for c, own in ways.items():
            for p in own:
                for k, x in enumerate(p):
                    near[c, x] = min(near.get((c, x), 99), k + 1)
        for a in ways:
            for b in ways:
                for p in ways[a]:
                    for q in ways[b]:
                        x = next((x for x in q if x in p), None)
                        if x is not None:
                            found.add((a, b, x))
                            short.setdefault((a, b), set()).add((p.index(x) + q.index(x) + 1, x))
        got = pt.joint_nodes(pairs, paths).collect()
        assert len(got) == len(found) and {(r["a"], r["b"], r["subsumer"]) for r in got} == found
        assert all((r["la"], r["lb"]) == (near[r["a"], r["subsumer"]], near[r["b"], r["subsumer"]]) for r in got)
        want = {(a, b, x, n) for (a, b), s in short.items() for n, x in s if n == min(s)[0]}
        assert {(r["a"], r["b"], r["subsumer"], r["len"]) for r in pt.lcs_by_path(pairs, paths).collect()} == want
        assert sorted((r["a"], r["b"], r["len"]) for r in pt.path_lengths(pairs, paths).collect()) == sorted((a, b, min(s)[0]) for (a, b), s in short.items())
        nodes = spark.createDataFrame([("n", x) for x in {x for _, x in near} if x], "pos string, id long")
        own = pt.synset_depth(pt.root_paths(isa, nodes, root_node), "numeric", root_node)
        depths = own.unionByName(spark.createDataFrame([("n", 0, 1, 0)], "pos string, id long, depth int, root long"))
        columns = ["a", "b", "subsumer", "depth", "root"]
        assert sorted(pt.joint_nodes(pairs, paths, "deepest").select(columns).collect()) == sorted(pt.lcs_by_depth(pairs, paths, depths).select(columns).collect())


def test_concepts_of_many_paths(spark):
    """Two chains of 13 diamonds, 8,192 ways each, that join: the pair's work is that of its ancestors."""
    links, top = [], 1
    for chain in (100, 200):
        below = top
        for k in range(13):
            one, two, low = chain + 3 * k, chain + 3 * k + 1, chain + 3 * k + 2
            links += [("n", one, below), ("n", two, below), ("n", low, one), ("n", low, two)]
            below = low
    isa = spark.createDataFrame(links, "pos string, child long, parent long")
    ends = spark.createDataFrame([("n", 138), ("n", 238)], "pos string, id long")
    pairs = spark.createDataFrame([("n", 138, 238)], "pos string, a long, b long")
    paths = pt.root_paths(isa, ends, True)
    assert paths.count() == 2 * 2**13
    assert [tuple(r) for r in pt.joint_nodes(pairs, paths).collect()] == [("n", 138, 238, 1, 27, 27)]


def test_circles_keep_pairs_of_paths(spark):
    lexicon, _ = make(spark, [(1, 2), (2, 1), (1, 3), (4, 1), (5, 2)])
    for name, want in (("path", 1 / 4), ("wup", 0.6)):
        got = scores(spark, lexicon, [(4, 5)], name)[4, 5]
        assert got["err_level"] == 0 and (name == "wup" or got["score"] == pytest.approx(want))


def test_hso_pairs_stay_in_their_rows(spark):
    """A pair goes to its links, to its second and to its first concept, and never back to its row; rows that are equal, or lack a concept, come back."""
    edges = [(2, 1), (3, 1), (4, 2)]
    lexicon, _ = make(spark, edges, nodes=[5], extra=[("hypo", "n", b, "n", a) for a, b in edges] + [("sim", "n", 3, "n", 5), ("sim", "n", 5, "n", 3)])
    rows = [(a, b, False) for a, b in [(2, 3), (2, 3), (4, 3), (4, 1), (1, 4), (3, 5), (4, 4), (None, 4)]] + [(2, 1, True), (1, 2, True), (2, 1, False)]
    pairs = spark.createDataFrame([("n", a, "n", b, w) for a, b, w in rows], "pos_a string, a long, pos_b string, b long, within boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = ms.score(lexicon, pairs, "hso")
        assert "Join " not in scored._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = sorted((r["a"] or 0, r["b"], r["within"], r["score"] if r["score"] is not None else -1) for r in scored.collect())
    assert got == sorted([(2, 3, False, 5), (2, 3, False, 5), (4, 3, False, 4), (4, 1, False, 6), (1, 4, False, 6), (3, 5, False, 16), (4, 4, False, 16), (0, 4, False, -1), (2, 1, True, 16), (1, 2, True, 16), (2, 1, False, 0)])
