"""Readers, writers, texts and senses on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from relspark import cli
from relspark.functions import compounds as cp, morph as mp, overlap as ov, text as tx
from relspark.lexicon import Lexicon
from relspark.operators import relations as rel, senses as sn, vectors as vec
from relspark.plans import measures as ms
from relspark.sources import corpora, lists, tables, wndb
from relspark.streaming import scoring

#: A tiny database in the public format, written for these tests.
DATA_NOUN = """  1 licence text
00000100 03 n 02 thing 0 entity 0 003 ~ 00000200 n 0000 ~ 00000300 n 0000 ~ 00000600 n 0000 | that which is
00000200 03 n 01 animal 0 003 @ 00000100 n 0000 ~ 00000400 n 0000 ~ 00000500 n 0000 | a living thing; "the animal sleeps"
00000300 03 n 01 tool 0 001 @ 00000100 n 0000 | a thing for work
00000400 03 n 02 dog 0 guard_dog 0 003 @ 00000200 n 0000 + 00000900 v 0101 ! 00000500 n 0101 | an animal that barks; "the dog barked"; "a good dog"
00000500 03 n 01 Cat 0 002 @ 00000200 n 0000 ! 00000400 n 0101 | an animal that purrs
00000600 03 n 01 guard 0 001 @ 00000100 n 0000 | one who watches
"""
DATA_VERB = """  1 licence text
00000900 30 v 01 dog 0 001 @ 00000910 v 0000 01 + 02 00 | follow; "he dogged her"
00000910 30 v 01 move 0 001 ~ 00000900 v 0000 01 + 02 00 | change place
"""
INDEX_NOUN = "  1 licence text\nanimal n 1 2 @ ~ 1 0 00000200\ncat n 1 2 @ ! 1 0 00000500\ndog n 1 3 @ + ! 1 0 00000400\nentity n 1 1 ~ 1 0 00000100\nguard n 1 1 @ 1 0 00000600\nguard_dog n 1 1 @ 1 0 00000400\nthing n 1 1 ~ 1 0 00000100\ntool n 1 1 @ 1 0 00000300\n"
INDEX_VERB = "  1 licence text\ndog v 1 1 @ 1 0 00000900\nmove v 1 1 ~ 1 0 00000910\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("wn")
    for name, text in {"data.noun": DATA_NOUN, "data.verb": DATA_VERB, "index.noun": INDEX_NOUN, "index.verb": INDEX_VERB, "data.adj": "  1\n", "data.adv": "  1\n", "index.adj": "  1\n", "index.adv": "  1\n", "index.sense": "dog%1:03:00:: 00000400 1 5\ndog%2:30:00:: 00000900 1 1\nfast%3:00:00:: 00000001 1 0\n", "cntlist": "5 dog%1:03:00:: 1\n2 dog%2:30:00:: 1\n9 fast%3:00:00:: 1\n"}.items():
        (path / name).write_text(text)
    return str(path)


@pytest.fixture(scope="module")
def lexicon(spark, folder):
    return wndb.read_lexicon(spark, folder)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_database(lexicon):
    synsets = {(r["pos"], r["id"]): r for r in lexicon.synset.collect()}
    assert synsets["n", 400]["words"] == ["dog", "guard_dog"] and synsets["n", 400]["gloss"].startswith("an animal that barks")
    edges = {(r["rel"], r["src"], r["dst"], r["src_word"], r["dst_word"]) for r in lexicon.edge.collect()}
    assert ("hype", 400, 200, None, None) in edges and ("ants", 400, 500, "dog", "cat") in edges and ("deri", 400, 900, "dog", "dog") in edges
    assert {(r["word"], r["pos"], r["sense"], r["id"], r["word_no"]) for r in lexicon.sense.where("word like '%dog'").collect()} == {("dog", "n", 1, 400, 1), ("guard_dog", "n", 1, 400, 2), ("dog", "v", 1, 900, 1)}


def test_side_files(spark, folder):
    assert [tuple(r) for r in wndb.read_cntlist(spark, f"{folder}/cntlist").collect()] == [(5, "dog%1:03:00::"), (2, "dog%2:30:00::")]
    assert [tuple(r) for r in wndb.read_sense_index(spark, f"{folder}/index.sense").collect()] == [("dog%1:03:00::", "n", 400), ("dog%2:30:00::", "v", 900)]


def test_counts_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([("n", 100, 7.0, True), ("n", 20, 2.5, False), ("v", 9, 1.0, True)], "pos string, id long, freq double, is_root boolean")
    tables.write_counts(counts, str(tmp_path / "ic"), "abc")
    assert sorted(map(tuple, tables.read_counts(spark, str(tmp_path / "ic"), "abc").collect())) == sorted(map(tuple, counts.collect()))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "ic")).collect()]
    assert lines == ["wnver::abc", "20n 2.5", "100n 7 ROOT", "9v 1 ROOT"]
    with pytest.raises(tables.FormatError):
        tables.read_counts(spark, str(tmp_path / "ic"), "other")
    (tmp_path / "bad").write_text("wnver::abc\n20n two\n")
    assert not tables.is_count_file(spark, str(tmp_path / "bad"))
    (tmp_path / "twice").write_text("wnver::abc\n20n 2\n20n 3\n")
    assert [r["freq"] for r in tables.read_counts(spark, str(tmp_path / "twice")).collect()] == [3]


def test_depths_round_trip(spark, tmp_path):
    depths = spark.createDataFrame([("n", 5, 9, 1740), ("n", 5, 10, 1740), ("n", 1740, 1, 1740)], "pos string, id long, depth int, root long")
    tables.write_synset_depths(depths, str(tmp_path / "d"), "v")
    got = tables.read_synset_depths(spark, str(tmp_path / "d"), "v", False)
    assert {(r["id"], r["depth"], r["root"]) for r in got.collect()} == {(5, 9, 1740), (5, 10, 1740), (1740, 1, 1740)}
    assert {r["id"]: r["depth"] for r in tables.first_depth(got).collect()} == {5: 10, 1740: 1}
    rooted = tables.read_synset_depths(spark, str(tmp_path / "d"), "v")
    assert (0, 1, 0) in {(r["id"], r["depth"], r["root"]) for r in rooted.collect()}
    top = spark.createDataFrame([("n", 0, 11), ("n", 1740, 10)], "pos string, root long, depth int")
    tables.write_taxonomy_depths(top, str(tmp_path / "t"), "v")
    assert {tuple(r) for r in tables.read_taxonomy_depths(spark, str(tmp_path / "t")).collect()} == {("n", 0, 11), ("n", 1740, 10)}


def test_vectors_round_trip(spark, tmp_path):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b")], "doc int, word string")
    dims, made = vec.build_vectors(tokens, 2)
    assert {tuple(r) for r in made.collect()} == {("a", "a", 4), ("a", "b", 2), ("b", "a", 2), ("b", "b", 2)}
    tables.write_vectors(str(tmp_path / "v"), 2, dims, made)
    n, dims2, made2 = tables.read_vectors(spark, str(tmp_path / "v"))
    assert n == 2 and {tuple(r) for r in dims2.collect()} == {("a", 0, 2, 1), ("b", 1, 2, 2)}
    assert {tuple(r) for r in made2.collect()} == {("a", 0, 4.0), ("a", 1, 2.0), ("b", 0, 2.0), ("b", 1, 2.0)}
    cut = vec.build_vectors(tokens, 2, cutoff=0.5)[0]
    assert [r["word"] for r in cut.collect()] == ["b"]  # the higher tf-idf goes


def test_corpora(spark):
    docs = lambda text: spark.createDataFrame([("d", text)], "doc string, text string")
    blocks = lambda df: [r["block"].strip() for r in df.orderBy("at").collect()]
    assert blocks(corpora.raw_text(docs("One two,\nthree four. Five\nsix"))) == ["One two", "three four", "Five six"]
    assert blocks(corpora.raw_text(docs("One two,\nthree four. Five\nsix"), False)) == ["One two three four", "Five six"]
    assert blocks(corpora.brown(docs("A01 0010 The jury said. It\nA01 0020 did"))) == ["The jury said", "It did"]
    assert blocks(corpora.bnc(docs("<head>no</head><s n=1><w NN1>Dogs &amp; [x] bark</s>\n<s n=2>two</s>"))) == ["Dogs   bark", "two"]
    assert blocks(corpora.bnc(docs("<s n=1>caf&eacute;s</s>"))) == ["cafs"]
    assert blocks(corpora.treebank(docs(".START\nOne two\nthree\n\n.START four"))) == ["One two three", "four"]
    assert [r["word"] for r in corpora.semcor_lemmas(docs("<wf cmd=done pos=NN lemma=dog wnsn=1>Dogs</wf><wf cmd=ignore pos=DT>the</wf>")).collect()] == ["dog"]


def test_scalars(spark):
    assert one(spark, tx.clean(F.lit("A dog's \"best\" friend--well-known!"))) == "a dog's best friend well-known"
    assert one(spark, tx.join_numbers(F.lit("1 2 3 a 4"))) == "123 a 4"
    assert one(spark, tx.definition(F.lit('a; "b"; "c"'))) == "a; " and one(spark, tx.examples(F.lit('a; "b"; "c"'))) == ["b", "c"]
    assert one(spark, tx.pad_id(F.lit(42))) == "00000042" and one(spark, tx.trimmed_decimal(F.lit(0.25))) == "0.25" and one(spark, tx.trimmed_decimal(F.lit(2.0))) == "2"
    assert one(spark, tx.vector_words(F.lit("Earth's end"), False)) == "arths end"
    assert len(one(spark, tx.lexicon_hash(F.array(F.lit(1), F.lit(2))))) == 27


#: For each markup a text whose units go on over lines, and the function for whole texts.
LONG = {
    "raw": ("".join(f"word{i}{', ' if i % 7 == 3 else ' '}{chr(10) if i % 5 == 0 else ''}{'. ' if i % 23 == 0 else ''}" for i in range(900)) + "\r\nlast\r\n" + "no border " * 40 + "\n" * 3, corpora.raw_text),
    "raw_loose": ("".join(f"a{i}{',' if i % 3 == 0 else ''}{chr(10) if i % 4 == 0 else ' '}" for i in range(600)) + "end.\r\n;:\nx", lambda d: corpora.raw_text(d, False)),
    "brown": ("".join(f"A{i % 40:02} {i:04} the word{i} {'said. So' if i % 4 == 0 else 'is'}\n" for i in range(400)), corpora.brown),
    "bnc": ("<head>\nnot this\n</head>\n" + "".join(f"<s\nn={i}><w NN{i}>dog{i} &amp; [pause]{chr(10) * (i % 3)}<w\nVV>barks</s>\n" for i in range(200)), corpora.bnc),
    "treebank": ("\n\n" + "".join(f".START word{i}\ngoes on\n{' ' * (i % 3)}{chr(10) if i % 4 == 0 else 'line'}\n" for i in range(300)) + "\n  ", corpora.treebank),
    "semcor": ("".join(f"<wf cmd={'done' if i % 3 else 'ignore'} pos=NN\nlemma=dog{i % 50} wnsn=1>Dogs</wf>{chr(10) * (i % 2)}" for i in range(300)), corpora.semcor_lemmas),
}


@pytest.mark.parametrize("markup", LONG)
@pytest.mark.parametrize("size", [37, 400, 1 << 20])
def test_units_over_splits(spark, tmp_path, markup, size):
    """Files cut at every few bytes give what the reader of whole files gives."""
    text, whole = LONG[markup]
    for name, content in {"a.txt": text, "b.txt": text[: len(text) // 3], "empty.txt": "", "one.txt": "only this"}.items():
        (tmp_path / name).write_bytes(content.encode())
    expected = whole(corpora.whole_files(spark, str(tmp_path)))
    if "word" in expected.columns:
        expected = expected.withColumnRenamed("word", "block")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        got = corpora.read(spark, str(tmp_path), markup)
        if size == 37:
            assert got.rdd.getNumPartitions() > 4
        got = [(r["doc"], r["at"], r["block"].strip(" ")) for r in got.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    theirs = {}
    for r in expected.collect():
        theirs.setdefault(r["doc"], []).append(r["block"].strip(" "))
    ours = {}
    for doc, _, block in sorted(got):
        ours.setdefault(doc, []).append(block)
    assert ours == theirs  # in the order of each file
    assert len({g[:2] for g in got}) == len(got)


def test_compounds(spark):
    known = {"new_york", "new_york_city"}
    assert cp.greedy("in new york city now".split(), known) == ["in", "new_york_city", "now"]
    words = spark.createDataFrame([(w,) for w in known], "word string")
    docs = spark.createDataFrame([(1, "in new york city new york"), (2, ""), (3, "new")], "k int, t string")
    assert {r["k"]: r["compounds"] for r in cp.compoundify(docs, "t", words).collect()} == {1: "in new_york_city new_york", 2: "", 3: "new"}
    nulls = docs.unionByName(docs.selectExpr("9 as k", "cast(null as string) as t").limit(1))
    assert sorted(map(str, cp.compoundify(nulls, "t", words, max_bytes=0).collect())) == sorted(map(str, cp.compoundify(nulls, "t", words).collect()))
    split = docs.withColumn("ws", tx.words(F.col("t")))
    assert [(r["k"], r["token"]) for r in cp.compound_tokens(split, words, "k", "ws").orderBy("k", "at").collect()] == [(1, "in"), (1, "new_york_city"), (1, "new_york"), (3, "new")]


@pytest.mark.parametrize("cells", [1, 60, 1 << 21])
def test_phrases_of_many_pairs(monkeypatch, cells):
    """Equal to one pair at a time, on texts that repeat few words, with stop words, in any chunks."""
    import numpy as np

    monkeypatch.setattr(ov, "CELLS", cells)
    rng = np.random.default_rng(7)
    text = lambda: [f"w{k}" for k in rng.integers(0, rng.integers(1, 9), rng.integers(0, 25))]
    left, right = [text() for _ in range(300)], [text() for _ in range(300)]
    for stop in (frozenset(), frozenset(["w0", "w2"])):
        expected = [sum(len(p) ** 2 for p in ov.overlaps(a, b, stop)) for a, b in zip(left, right)]
        assert ov.squared_phrases(left, right, stop).tolist() == expected
    assert ov.squared_phrases([], [], frozenset()).tolist() == []


def test_overlaps():
    assert ov.overlaps("a b c d".split(), "x b c a".split()) == [["b", "c"], ["a"]]
    assert ov.overlaps("the of dog".split(), "the of cat dog".split(), frozenset(["the", "of"])) == [["dog"]]
    assert ov.overlaps("a b a b".split(), "a b".split()) == [["a", "b"]] and ov.overlaps([], ["a"]) == []


def test_morphology(spark, lexicon):
    forms = spark.createDataFrame([("Dogs",), ("animals",), ("dogged",), ("tools",), ("zzz",), ("geese",)], "word string")
    listed = spark.createDataFrame([("geese", "n", "animal")], "form string, pos string, lemma string")
    got = {tuple(r) for r in mp.morph_table(forms, lexicon.sense, listed).collect()}
    assert got == {("dogs", "n", "dog"), ("dogs", "v", "dog"), ("animals", "n", "animal"), ("tools", "n", "tool"), ("geese", "n", "animal")}
    texts = spark.createDataFrame([(1, "two dogs and zzz")], "k int, t string")
    morph = mp.morph_table(spark.createDataFrame([("two",), ("dogs",), ("and",), ("zzz",)], "word string"), lexicon.sense)
    assert [r["stemmed"] for r in mp.stem_text(texts, "k", "t", morph).collect()] == ["two dog and zzz"]


def test_lists(spark, tmp_path):
    assert lists.parse_relations("RelationFile\nexample(hype(hype))-syns(sim) 0.5\nhypo-glos\n") == [(["hype", "hype", "example"], ["sim", "syns"], 0.5), (["hypo", "glos"], ["glos"], 1.0)]
    assert lists.parse_vector_relations("VectorRelationFile\nhype(hypo)\nglos(mero)\n") == [["hypo", "hype", "glosexample"], ["mero", "glos"]]
    for bad in ("no header\nglos-glos", "RelationFile\nglos", "RelationFile\nfoo-glos", "RelationFile\nhype(glos)-glos", "RelationFile\nhype((glos-glos"):
        with pytest.raises(ValueError):
            lists.parse_relations(bad)
    (tmp_path / "pairs").write_text("dog cat // both\n# no\ndog\ndog#n#1   cat#n#1\n\none two three\n")
    assert [tuple(r) for r in lists.read_word_pairs(spark, str(tmp_path / "pairs")).collect()] == [("dog", "cat"), ("dog#n#1", "cat#n#1")]
    (tmp_path / "stop").write_text(" the \nin  front\n\n")
    assert {r["word"] for r in lists.stop_list(spark, str(tmp_path / "stop")).collect()} == {"the", "in_front"}


@pytest.mark.parametrize("line", ["trace::11", "adfjkl::1", "cache::2", "maxCacheSize::-1", "trace::nothanks", "trace::1\ntrace::2"])
def test_bad_options(line):
    assert lists.parse_config(f"path\n{line}\n", "path").err_level == 1


def test_options():
    got = lists.parse_config("Some::Package::lesk\n# note\nnormalize :: 1\nmaxCacheSize::unlimited\nrelation::a/b # c\n", "lesk")
    assert (got.err_level, got.values["normalize"], got.values["maxCacheSize"], got.values["relation"], got.values["stem"]) == (0, 1, "unlimited", "a/b", 0)
    assert lists.parse_config("vector_pairs\n", "vector").err_level == 2 and lists.parse_config("", "path").err_level == 2


def test_validation(spark, lexicon):
    given = ["dog#n#1", "dog#n", "dog#x#1", "dog#n#one", "", None, "#n#1", "dog#n#7", "dog#n#1#2", "dog##1"]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(given)], "i int, wps string")
    got = {r["i"]: r for r in sn.validate(frame, "wps", lexicon.sense).collect()}
    assert got[0]["id"] == 400 and got[0]["err_level"] == 0 and got[0]["err_msg"] is None
    assert all(got[i]["err_level"] == 1 and got[i]["id"] is None and got[i]["err_msg"] for i in range(1, len(given)))
    assert len({got[i]["err_msg"].split("(")[0] for i in range(1, len(given))}) >= 7
    first = sn.canonical(spark.createDataFrame([("n", 400), ("n", 1)], "pos string, id long"), lexicon.sense).collect()
    assert {r["id"]: r["wps"] for r in first} == {400: "dog#n#1", 1: None}
    two = spark.createDataFrame([("dog#n#1", "dog#v#1", 7), ("dog#n#9", "dog#x#1", 8), ("dog#n#9", "", 9), (None, "dog#n#1", 10)], "wps1 string, wps2 string, id int")
    both = {r["id"]: r for r in sn.validate_pairs(two, lexicon.sense).collect()}
    assert both[7]["id_a"] == 400 and both[7]["id_b"] is not None and both[7]["err_level"] == 0 and both[7]["err_msg"] is None
    assert all(both[i]["id_a"] is None and both[i]["id_b"] is None and both[i]["err_level"] == 1 for i in (8, 9, 10))
    assert "dog#n#9" in both[8]["err_msg"] and both[9]["err_msg"] == both[10]["err_msg"] == "Undefined input sense."
    errors = spark.createDataFrame([("n and v are different parts of speech.",), ("v and n are different parts of speech.",), ("other",), (None,)], "err_msg string")
    assert sn.distinct_errors(errors).count() == 2


def test_lookup(spark, lexicon):
    words = spark.createDataFrame([(w,) for w in ("dog", "dog#v", "dog#nv", "dog#n#1", "dogs", "guard dog", "none", "dog#n#9")], "input string")
    morph = mp.morph_table(spark.createDataFrame([("dogs",), ("dog",)], "word string"), lexicon.sense)
    got = {}
    for r in sn.lookup(words, lexicon.sense, morph).collect():
        got.setdefault(r["input"], set()).add(r["wps"])
    assert got == {"dog": {"dog#n#1", "dog#v#1"}, "dog#v": {"dog#v#1"}, "dog#nv": {"dog#n#1", "dog#v#1"}, "dog#n#1": {"dog#n#1"}, "dogs": {"dog#n#1", "dog#v#1"}, "guard dog": {"guard_dog#n#1"}}


def test_ranking(spark):
    rows = spark.createDataFrame([("a", "b", 0.501), ("a", "c", 0.499), ("a", "d", 0.2), ("a", "e", None)], "w1 string, w2 string, score double")
    ranked = sn.rank_pairs(rows)
    assert {r["w2"]: r["rank"] for r in ranked.collect()} == {"b": 1, "c": 1, "d": 3, "e": 4}
    assert "a<>b<>1 0.50 0 0 0" in [r["line"] for r in lists.ranking_lines(ranked).collect()]
    other = rows.withColumn("score", -F.col("score"))
    full = rows.where("score is not null")
    assert sn.spearman(full, full).collect()[0]["rho"] == pytest.approx(1) and sn.spearman(full, other.where("score is not null")).collect()[0]["rho"] == pytest.approx(-1)


def test_relations(spark, lexicon):
    start = spark.createDataFrame([("k", "n", 400), ("k", "n", 300)], "key string, pos string, id long")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(rel.expand(lexicon, "hype", start)) == [100, 200] and ids(rel.expand(lexicon, "hypo", rel.expand(lexicon, "hype", start))) == [200, 300, 400, 500, 600]
    texts = lambda *f: [r["texts"] for r in rel.compose(lexicon, list(f), start).collect()][0]
    assert texts("example") == ["the dog barked", "a good dog"] and texts("glos") == ["a thing for work", "an animal that barks"] and texts("hype") == ["that which is", "a living thing"]
    assert texts("syns") == ["tool", "dog guard_dog"]
    with pytest.raises(ValueError):
        rel.compose(lexicon, ["glos", "hype"], start)


def test_relations_between_words(spark):
    """Each step of a composition goes on from the word that the last one reached."""
    sense = spark.createDataFrame([(w, "n", 1, i, k) for i, ws in {1: "a1 a2", 2: "b1 b2", 3: "c1", 4: "d1"}.items() for k, w in enumerate(ws.split(), 1)], "word string, pos string, sense int, id long, word_no int")
    edge = spark.createDataFrame(
        [("deri", "n", 1, "n", 2, "a1", "B2"), ("deri", "n", 1, "n", 3, "a2", "c1"), ("pert", "n", 2, "n", 3, "b1", "c1"), ("pert", "n", 2, "n", 4, "b2", "d1"), ("hype", "n", 1, "n", 2, None, None), ("domn", "n", 2, "n", 4, None, None)],
        "rel string, src_pos string, src long, dst_pos string, dst long, src_word string, dst_word string",
    )
    made = Lexicon(spark.createDataFrame([], "pos string, id long, gloss string, words array<string>"), sense, edge)
    start = spark.createDataFrame([("k", "n", 1)], "key string, pos string, id long")
    found = lambda df: sorted((r["id"], r["word"]) for r in df.collect())
    first = rel.expand(made, "deri", start)
    assert found(first) == [(2, "B2")] and found(rel.expand(made, "pert", first)) == [(4, "d1")]
    assert found(rel.expand(made, "deri", start.selectExpr("*", "'a2' as word"))) == [(3, "c1")]
    assert found(rel.expand(made, "pert", rel.expand(made, "hype", start))) == [(3, "c1")]  # a concept's first word
    assert found(rel.expand(made, "domn", first)) == [(4, None)]  # a relation of whole concepts holds for every word
    assert found(rel.expand(made, "deri", start.selectExpr("*", "cast(null as string) as word"))) == [(2, "B2")]


def pairs(spark, *rows):
    return spark.createDataFrame([("n", a, "n", b) for a, b in rows], "pos_a string, a long, pos_b string, b long")


def test_definition_measures(spark, lexicon):
    got = {(r["a"], r["b"]): r["score"] for r in ms.score(lexicon, pairs(spark, (400, 500), (400, 300), (400, 400)), "lesk", ms.Config(relations=[(["glos"], ["glos"], 2.0)])).collect()}
    assert got == {(400, 500): 18.0, (400, 300): 0.0, (400, 400): 32.0}
    tokens = lexicon.synset.select(F.col("id").alias("doc"), F.explode(tx.words(tx.vector_words(F.col("gloss")))).alias("word"))
    config = ms.Config(vectors=vec.build_vectors(tokens, 8)[1], vector_relations=[["glos"], ["hype", "glos"]], relations=[(["glos"], ["glos"], 1.0), (["hype", "glos"], ["glos"], 1.0)])
    for name in ("vector", "vector_pairs"):
        got = {(r["a"], r["b"]): r["score"] for r in ms.score(lexicon, pairs(spark, (400, 400), (400, 500), (500, 400)), name, config).collect()}
        assert 0 < got[400, 500] <= 1 + 1e-9
        if name == "vector":
            assert got[400, 400] == pytest.approx(1) and got[400, 500] == pytest.approx(got[500, 400])


def test_stems(spark, lexicon):
    morph = spark.createDataFrame([("barks", "v", "bark"), ("animal", "n", "animal"), ("saws", "n", "saw"), ("saws", "v", "see")], "form string, pos string, lemma string")
    both = spark.createDataFrame([("animal barks \x01a saws", "barks"), ("", "saws")], "text_a string, text_b string")
    got = {(r["text_a"], r["text_b"]) for r in ms.stemmed(both, morph).collect()}
    assert got == {("animal bark \x01a saws", "bark"), ("", "saws")}  # two base forms: the word stays
    config = ms.Config(stem=morph)
    texts = spark.createDataFrame([("k", "animal barks saws")], "key string, t string")
    assert sorted(r["word"] for r in ms.text_words(texts, F.col("t"), config, "key").collect()) == ["animal", "bark", "saw"]


def test_commands(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "ic")
    (tmp_path / "corpus.txt").write_text("The dogs saw a dog, the cat.\nAnimals!")
    assert cli.main(["count", "--wnpath", folder, "--outfile", out, "--infile", str(tmp_path / "corpus.txt")], spark) == 0
    assert {r["id"]: r["freq"] for r in tables.read_counts(spark, out).where("pos = 'n'").collect()} == {100: 4, 200: 4, 300: 0, 400: 2, 500: 1, 600: 0}
    (tmp_path / "conf").write_text(f"res\ninfocontent::{out}\n")
    capsys.readouterr()
    cli.main(["similarity", "--wnpath", folder, "--type", "path", "dogs", "cat#n#1"], spark)
    assert capsys.readouterr().out.split() == ["dog#n#1", "cat#n#1", str(1 / 3)]
    cli.main(["similarity", "--wnpath", folder, "--type", "res", "--config", str(tmp_path / "conf"), "dog", "tool"], spark)
    assert capsys.readouterr().out.split()[2] == "0.0"
    cli.main(["compounds", "--wnpath", folder], spark)
    assert capsys.readouterr().out.split() == ["guard_dog"]
    cli.main(["depths", "--wnpath", folder, "--outfile", str(tmp_path / "t"), "--depthfile", str(tmp_path / "d")], spark)
    assert {(r["pos"], r["root"], r["depth"]) for r in tables.read_taxonomy_depths(spark, str(tmp_path / "t")).collect()} == {("n", 100, 3), ("n", 0, 4), ("v", 910, 2), ("v", 0, 3)}
    cli.main(["tags", "--wnpath", folder, "--outfile", str(tmp_path / "tags"), "--smooth"], spark)
    assert {r["id"]: r["freq"] for r in tables.read_counts(spark, str(tmp_path / "tags")).where("pos = 'v'").collect()} == {900: 3, 910: 4}
    cli.main(["vectors", "--wnpath", folder, "--outfile", str(tmp_path / "vec")], spark)
    assert tables.read_vectors(spark, str(tmp_path / "vec"))[0] == 8
    (tmp_path / "scores").write_text("a b 0.501\na c 0.499\na d 0.2\n")
    capsys.readouterr()
    cli.main(["rank", "--file", str(tmp_path / "scores")], spark)
    assert capsys.readouterr().out.splitlines() == ["a<>b<>1 0.50 0 0 0", "a<>c<>1 0.50 0 0 0", "a<>d<>3 0.20 0 0 0"]


def test_command_options(spark, folder, tmp_path, capsys):
    cli.main(["depths", "--wnpath", folder, "--outfile", str(tmp_path / "named"), "--depthfile", str(tmp_path / "d"), "--wps"], spark)
    roots = {r["value"].split()[1] for r in spark.read.text(str(tmp_path / "named")).where("value not like 'wnver%'").collect()}
    assert "00000000" in roots and len([r for r in roots if "#" in r]) == 2
    (tmp_path / "wup").write_text(f"wup\nsynsetDepthsFile::{tmp_path / 'd'}\n")
    shown = []
    for more in (["--config", str(tmp_path / "wup"), "--offsets", "--trace"], []):  # the file's depths are those of the lexicon
        capsys.readouterr()
        cli.main(["similarity", "--wnpath", folder, "--type", "wup", *more, "dog#n#1", "cat#n#1"], spark)
        shown.append(capsys.readouterr().out.splitlines())
    assert shown[0][0].split()[:2] == ["dog#n#00000400", "cat#n#00000500"] and "(3)" in shown[0][1]
    assert shown[1][0].split()[:2] == ["dog#n#1", "cat#n#1"] and shown[0][0].split()[2] == shown[1][0].split()[2]


def test_stream(spark, lexicon, tmp_path):
    source = tmp_path / "in"
    os.mkdir(source)
    (source / "1.txt").write_text("dog cat\n# note\n")
    lines = spark.readStream.text(str(source))
    for _ in range(2):
        scoring.score_stream(scoring.pair_lines(lines), lexicon, "path", scoring.parquet_sink(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination(120)
        (source / "2.txt").write_text("dog tool\n")
    got = {(r["w1"], r["w2"]): r["score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("dog", "cat"): pytest.approx(1 / 3), ("dog", "tool"): 0.25}


def test_service(spark, lexicon):
    asked = spark.createDataFrame([(1, "v"), (2, "s dog"), (3, "r dog cat path"), (4, "what"), (5, "g tool"), (6, "s none")], "request int, line string")
    got = {r["request"]: r["reply"] for r in scoring.answer(asked, lexicon, ("path",)).collect()}
    assert "relspark" in got[1] and "dog#v#1" in got[2] and '"score":0.333' in got[3] and "error" in got[4] and "a thing for work" in got[5] and "error" in got[6]
