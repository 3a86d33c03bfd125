"""The measures of relatedness, each a plan from pairs to scores.

``score(lexicon, pairs, measure, config)`` is the entry. pairs: pos_a, a, pos_b, b (and word_a,
word_b for hso). The result has the columns of pairs and score, err_level, err_msg. Equal pairs
are scored once. A new measure is a function registered under a name with ``measure``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from relspark.functions import morph as mp, text as tx
from relspark.functions.overlap import overlap_score
from relspark.lexicon import UNRELATED, Lexicon, materialize
from relspark.operators.joins import join_spread
from relspark.operators import information as info, paths as pt, relations as rel, senses as sn, vectors as vec, walks
from relspark.plans import cache as store
from relspark.plans.cache import ScoreCache
from relspark.sources.tables import first_depth

Relation = tuple[list[str], list[str], float]
#: A stop list goes to every task, so it must be a list and not a table.
MAX_STOP_WORDS = 100_000


@dataclass(frozen=True)
class Config:
    """Options of the measures, with the reference's defaults where Spark has a use for them."""

    root_node: bool = True
    counts: DataFrame | None = None  # pos, id, freq, is_root: for res, lin, jcn
    depth_order: str = "numeric"
    relations: list[Relation] = field(default_factory=lambda: [(["glosexample"], ["glosexample"], 1.0)])
    vector_relations: list[list[str]] = field(default_factory=lambda: [["glosexample"]])
    vectors: DataFrame | None = None  # word, dim, cnt: for vector, vector_pairs
    compounds: DataFrame | None = None
    stop: DataFrame | None = None  # word
    stem: DataFrame | None = None  # form, pos, lemma: words of texts become their base form, for lesk, vector, vector_pairs
    synset_depths: DataFrame | None = None  # pos, id, depth, root, place, as files have them: for wup, and lch without a root
    taxonomy_depths: DataFrame | None = None  # pos, root, depth: for lch
    normalize: bool = False
    text_size: int | None = None  # vector keeps one word more
    fold_case: bool = True
    max_random: float = 1.0
    trace: bool = False  # a column that tells what a score is made of, see plans.provenance
    cache: ScoreCache | None = None  # where scores are kept from run to run; not with trace


@dataclass(frozen=True)
class Measure:
    run: Callable[[Lexicon, DataFrame, Config], DataFrame]
    pos: tuple[str, ...]
    in_row: Callable[[Lexicon, DataFrame, Config], DataFrame] | None = None


MEASURES: dict[str, Measure] = {}
KEYS = ["pos_a", "a", "pos_b", "b"]
#: What hso reads of pairs besides: the words of both concepts, or whether one of these contains the other.
WORDS = ("word_a", "word_b", "within")


def measure(name: str, pos: tuple[str, ...], in_row=None):
    """Registers a function (lexicon, pairs, config) -> pos_a, a, pos_b, b, score for pairs of the named parts of speech. in_row, if there is one,
    gives rows (pos_a, a, pos_b, b, ..), which are written and need not be distinct, back with their score, or null; of measures on the taxonomy only if its height is known."""

    def add(run):
        MEASURES[name] = Measure(run, pos, in_row)
        return run

    return add


def score(lexicon: Lexicon, pairs: DataFrame, name: str, config: Config | None = None) -> DataFrame:
    """pairs with score, err_level and err_msg.

    Measures on the taxonomy know nouns and verbs, and pairs of one part of speech: else the
    score is -1000000 (different) or null (unknown), with an error. Pairs that no path connects
    get -1000000 and an error. The other measures compare across parts of speech.
    """
    if name not in MEASURES:
        raise ValueError(f"no measure {name!r}; there are {', '.join(sorted(MEASURES))}")
    m, config = MEASURES[name], config or Config()
    if config.cache is not None and not config.trace:
        plain = replace(config, cache=None)
        keys = [*KEYS, *(c for c in WORDS if c in pairs.columns and name == "hso")]
        return store.scored(config.cache, store.key_of(lexicon, name, plain), pairs, keys, lambda asked: score(lexicon, asked, name, plain))
    by_path = m.pos == sn.NOUN_VERB
    fixed, level, message = sn.pair_status(F.col("pos_a"), F.col("pos_b"), m.pos) if by_path else (F.lit(None).cast("double"), F.lit(0), F.lit(None).cast("string"))
    # Only hso reads words: for the others a concept of several words would be several pairs.
    words = [c for c in WORDS if c in pairs.columns and name == "hso"]
    fit = pairs.where(F.col("pos_a").isin(*m.pos) & F.col("pos_b").isin(*m.pos))
    if by_path:
        fit = fit.where("pos_a = pos_b")
    if m.in_row is not None and (lexicon.height is not None or not by_path) and not config.trace:
        rows = materialize(pairs)
        whole = F.col("pos_a") == F.col("pos_b") if by_path else F.col("pos_b").isin(*m.pos) & reduce(lambda x, c: x & F.col(c).isNotNull(), ["a", "b", *words], F.lit(True))
        fits = F.coalesce(F.col("pos_a").isin(*m.pos) & whole, F.lit(False))
        joined = m.in_row(lexicon, rows.where(fits), config).unionByName(rows.where(~fits).withColumn("score", F.lit(None).cast("double")))
    else:
        joined = pairs.join(m.run(lexicon, fit.select(*KEYS, *words).distinct(), config), [*KEYS, *words], "left")
    joined = joined.withColumn("_f", fixed).withColumn("_l", level).withColumn("_m", message)
    lost = by_path & F.col("score").isNull() & (F.col("_l") == 0) if by_path else F.lit(False)
    traced = []
    if config.trace:
        from relspark.plans import provenance

        if name in provenance.TRACES:
            told = provenance.texts(lexicon, fit.select(*KEYS, *words).distinct(), name, config)
            joined, traced = joined.join(told, [*KEYS, *words], "left"), [F.col("trace")]
    return joined.select(
        *pairs.columns,
        F.when(F.col("_l") > 0, F.col("_f")).when(lost, UNRELATED).otherwise(F.col("score")).alias("score"),
        F.when(lost, 1).otherwise(F.col("_l")).alias("err_level"), F.when(lost, F.lit("No path between the concepts.")).otherwise(F.col("_m")).alias("err_msg"), *traced,
    )


def same_pos(pairs: DataFrame) -> DataFrame:
    """The pairs, which are distinct and of one part of speech each, written: every step below reads them."""
    return materialize(pairs.select(F.col("pos_a").alias("pos"), "a", "b"))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("pos", F.col("a").alias("id")).unionByName(pairs.select("pos", F.col("b").alias("id"))).distinct()


def row_ends(rows: DataFrame) -> DataFrame:
    """(pos, id) of both concepts of rows with KEYS."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(f"pos_{s}").alias("pos"), F.col(s).alias("id")) for s in "ab")))).where("id is not null").distinct()


def both_pos(df: DataFrame, value: Column) -> DataFrame:
    return df.select(F.col("pos").alias("pos_a"), "a", F.col("pos").alias("pos_b"), "b", (value + F.lit(0.0)).alias("score"))


def member_paths(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """Written, as both sides of the pairs and the subsumers read them."""
    return materialize(pt.root_paths(lexicon.isa, ends(pairs), config.root_node, lexicon.height))


def path_in_row(lexicon: Lexicon, rows: DataFrame, config: Config) -> DataFrame:
    found = pt.lengths_in_row(rows, pt.root_paths(lexicon.isa, row_ends(rows), config.root_node, lexicon.height))
    return found.select(*rows.columns, (1.0 / F.col("len") + F.lit(0.0)).alias("score"))


@measure("path", sn.NOUN_VERB, path_in_row)
def path(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """One over the nodes on the shortest way."""
    p = same_pos(pairs)
    return both_pos(pt.path_lengths(p, member_paths(lexicon, p, config)), 1.0 / F.col("len"))


def rooted_depth(lexicon: Lexicon, config: Config) -> DataFrame:
    """pos, d: the depth of the taxonomy below the virtual root, a row for each part of speech, written."""
    if config.taxonomy_depths is None and config.depth_order == "numeric" and lexicon.height is not None:
        return materialize(pt.virtual_depth(lexicon.synset, lexicon.isa, lexicon.height).withColumnRenamed("depth", "d"))
    depth = config.taxonomy_depths if config.taxonomy_depths is not None else pt.taxonomy_depths(lexicon.synset, lexicon.isa, True, lexicon.height, config.depth_order)
    return materialize(depth.where("root = 0").groupBy("pos").agg(F.max("depth").alias("d")))


def lch_in_row(lexicon: Lexicon, rows: DataFrame, config: Config) -> DataFrame:
    if not config.root_node:
        return rows.join(lch(lexicon, rows.select(*KEYS).distinct(), config), KEYS, "left")
    depth = rooted_depth(lexicon, config).where("d > 0").select(F.col("pos").alias("pos_a"), "d")
    found = pt.lengths_in_row(rows, pt.root_paths(lexicon.isa, row_ends(rows), True, lexicon.height)).join(F.broadcast(depth), "pos_a", "left")
    return found.select(*rows.columns, (F.ln(2.0 * F.col("d") / F.col("len")) + F.lit(0.0)).alias("score"))


@measure("lch", sn.NOUN_VERB, lch_in_row)
def lch(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """ln(2 x depth of the taxonomy / nodes on the shortest way); the deepest taxonomy of all subsumers on shortest ways."""
    rows = shortest_in_taxonomies(lexicon, pairs, config).groupBy("pos", "a", "b").agg(F.min("len").alias("len"), F.max("d").alias("d"))
    return both_pos(rows.where("d > 0"), F.ln(2.0 * F.col("d") / F.col("len")))


def shortest_in_taxonomies(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """pos, a, b, subsumer, len, d: the subsumers on shortest ways, with the depth of the deepest taxonomy that each is in."""
    p = same_pos(pairs)
    paths = member_paths(lexicon, p, config)
    if config.root_node:  # every subsumer is below the virtual root; few of them are most pairs', so they are no key
        return pt.lcs_by_path(p, paths).join(F.broadcast(rooted_depth(lexicon, config)), "pos")
    found = materialize(pt.lcs_by_path(p, paths))
    subsumers = found.select("pos", F.col("subsumer").alias("id")).distinct()
    if config.synset_depths is not None:
        roots = subsumers.join(config.synset_depths.select("pos", "id", "root").distinct(), ["pos", "id"])
    else:
        roots = pt.taxonomies(pt.root_paths(lexicon.isa, subsumers, False, lexicon.height))
    depth = config.taxonomy_depths if config.taxonomy_depths is not None else pt.taxonomy_depths(lexicon.synset, lexicon.isa, False, lexicon.height, config.depth_order)
    deepest = roots.join(depth, ["pos", "root"]).groupBy("pos", F.col("id").alias("subsumer")).agg(F.max("depth").alias("d"))
    key = F.concat_ws(":", "pos", F.col("subsumer").cast("string")).alias("_key")
    return join_spread(found.select("*", key), deepest.select(key, "d"), "_key").drop("_key").where("d is not null")


@measure("wup", sn.NOUN_VERB)
def wup(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """2 d / (d1 + d2): d the depth of the deepest subsumer, d1 and d2 that and the shortest ways
    from the concepts to it. Of several deepest subsumers the one of the highest score counts."""
    rows = deepest_with_ways(lexicon, pairs, config)
    return both_pos(rows.groupBy("pos", "a", "b").agg(F.max(depth_ratio()).alias("s")), F.col("s"))


def depth_ratio() -> Column:
    return 2.0 * F.col("depth") / (F.col("depth") + F.col("la") - 1 + F.col("depth") + F.col("lb") - 1)


def deepest_with_ways(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """pos, a, b, subsumer, depth, la, lb: the deepest subsumers, with the nodes on the shortest ways from both concepts to each."""
    p = same_pos(pairs)
    paths = member_paths(lexicon, p, config)
    if config.synset_depths is None and config.depth_order == "numeric" and not pt.circular(paths):
        return pt.joint_nodes(p, paths, "deepest")
    found = materialize(pt.candidates(p, paths) if pt.circular(paths) else pt.joint_nodes(p, paths))
    candidates = materialize(found.select("pos", F.col("subsumer").alias("id")).distinct())
    virtual = candidates.where("id = 0").select("pos", "id", F.array("id").alias("path"))
    # A subsumer's own paths give its depth, and its distance to the concepts.
    own = pt.root_paths(lexicon.isa, candidates.where("id <> 0"), config.root_node, lexicon.height)
    own = materialize(own.select("pos", "id", "path").unionByName(virtual))
    if config.synset_depths is not None:
        depth = first_depth(config.synset_depths.where("id <> 0"))
    else:
        depth = pt.synset_depth(own.where("id <> 0"), config.depth_order, config.root_node)
    depth = depth.unionByName(candidates.where("id = 0").select("pos", "id", F.lit(1).alias("depth"), F.col("id").alias("root")))
    rows = pt.deepest(found, depth)
    return with_distances(materialize(rows), own, paths) if pt.circular(paths) else rows


def with_distances(deepest: DataFrame, own: DataFrame, paths: DataFrame) -> DataFrame:
    """deepest with la and lb, the nodes on the shortest ways from both concepts to the subsumer, where links run in circles."""
    every = materialize(own.unionByName(paths.select("pos", "id", "path")).distinct().withColumn("circular", F.lit(True)))
    down = deepest.select("pos", "a", F.col("subsumer").alias("b")).unionByName(deepest.select("pos", F.col("b").alias("a"), F.col("subsumer").alias("b"))).distinct()
    far = materialize(pt.path_lengths(down, every))
    one = far.select("pos", "a", F.col("b").alias("subsumer"), F.col("len").alias("la"))
    two = far.select("pos", F.col("a").alias("b"), F.col("b").alias("subsumer"), F.col("len").alias("lb"))
    return deepest.join(one, ["pos", "a", "subsumer"]).join(two, ["pos", "b", "subsumer"])


def informed(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """pos, a, b, subsumer, ic_l, ic_a, ic_b, freq_l, freq_a, freq_b, root_freq."""
    if config.counts is None:
        raise ValueError("the measure needs config.counts")
    if lexicon.height is not None:
        p = materialize(pairs.select(*KEYS))
        found = informed_rows(lexicon, p, config).where("subsumer is not null")
        return found.select(F.col("pos_a").alias("pos"), "a", "b", "subsumer", *(f"{f}_{s}" for f in ("ic", "freq") for s in "lab"), "root_freq")
    p = same_pos(pairs)
    counts = materialize(config.counts)
    known = materialize(info.information(counts))
    found = pt.with_ic(p, member_paths(lexicon, p, config), known)
    first = F.min(F.struct((F.lit(0.0) - F.col("ic")).alias("less"), "subsumer")).alias("m")
    top = found.groupBy("pos", "a", "b").agg(first).select("pos", "a", "b", (F.lit(0.0) - F.col("m.less")).alias("ic_l"), "m.subsumer")
    out = top
    for name, key in (("l", "subsumer"), ("a", "a"), ("b", "b")):
        side = known.select("pos", F.col("id").alias(key), F.col("freq").alias(f"freq_{name}"), *([F.col("ic").alias(f"ic_{name}")] if name != "l" else []))
        out = out.join(side, ["pos", key], "left")
    zero = {f"freq_{n}": 0.0 for n in "lab"} | {"ic_a": 0.0, "ic_b": 0.0}
    return out.join(F.broadcast(info.root_frequency(counts)), "pos", "left").fillna(zero | {"root_freq": 0.0})  # a row for each part of speech


def informed_rows(lexicon: Lexicon, rows: DataFrame, config: Config) -> DataFrame:
    """rows, which are written and have KEYS, with what `informed` gives; subsumer is null where there is none."""
    if config.counts is None:
        raise ValueError("the measure needs config.counts")
    counts = materialize(config.counts)
    ways = pt.counted_ways(lexicon.isa, row_ends(rows), counts, lexicon.height, config.root_node)
    found = pt.informed_in_row(rows, ways, info.root_frequency(counts)).fillna({"root_freq": 0.0, "freq_a": 0.0, "freq_b": 0.0, "freq_l": 0.0})
    return found.select("*", *(info.ic_of(info.share_of(F.col(f"freq_{s}"), F.col("root_freq"))).alias(f"ic_{s}") for s in "lab"))


def informed_score(formula: Callable[[], Column]):
    def in_row(lexicon: Lexicon, rows: DataFrame, config: Config) -> DataFrame:
        return informed_rows(lexicon, rows, config).select(*rows.columns, F.when(F.col("subsumer").isNotNull(), formula() + F.lit(0.0)).alias("score"))

    return in_row


def res_of() -> Column:
    return F.col("ic_l")


def lin_of() -> Column:
    return F.when((F.col("ic_a") == 0) | (F.col("ic_b") == 0), 0.0).otherwise(F.try_divide(2.0 * F.col("ic_l"), F.col("ic_a") + F.col("ic_b")))


def jcn_of() -> Column:
    r = F.col("root_freq")
    at_zero = F.when(r > 0.01, 1.0 / -F.ln((F.when(r > 0.01, r).otherwise(1.0) - 0.01) / F.when(r > 0.01, r).otherwise(1.0))).otherwise(0.0)
    return (
        F.when(r == 0, 0.0).when((F.col("ic_a") == 0) | (F.col("ic_b") == 0), 0.0)
        .when((F.col("freq_a") == F.col("freq_l")) & (F.col("freq_b") == F.col("freq_l")), at_zero)
        .otherwise(F.try_divide(F.lit(1.0), F.col("ic_a") + F.col("ic_b") - 2.0 * F.col("ic_l")))
    )


@measure("res", sn.NOUN_VERB, informed_score(res_of))
def res(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """Information of the subsumer of most information."""
    return both_pos(informed(lexicon, pairs, config), res_of())


@measure("lin", sn.NOUN_VERB, informed_score(lin_of))
def lin(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """Twice the subsumer's information over the sum of the concepts'; 0 if one of them has none."""
    return both_pos(informed(lexicon, pairs, config), lin_of())


@measure("jcn", sn.NOUN_VERB, informed_score(jcn_of))
def jcn(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """One over the distance ic_a + ic_b - 2 ic_l; 0 where a concept has no information, or none is
    counted. At distance 0, which is where all three frequencies are equal, the distance is that
    of a frequency a hundredth below the root's."""
    return both_pos(informed(lexicon, pairs, config), jcn_of())


def hso_in_row(lexicon: Lexicon, rows: DataFrame, config: Config) -> DataFrame:
    return walks.relatedness(rows, walks.links(lexicon.edge, lexicon.sense))


@measure("hso", sn.ALL_POS, hso_in_row)
def hso(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """Strong links 16, walks by length and turns. The order of a pair matters."""
    return hso_in_row(lexicon, materialize(pairs), config)


def joined_texts(lexicon: Lexicon, relations: list[Relation], pairs: DataFrame) -> DataFrame:
    """Each side's texts as one, with a word that occurs in no text between them."""
    both = rel.super_glosses(lexicon, relations, pairs)
    return both.select(*KEYS, "rid", "weight", F.array_join("texts_a", " \u0001a ").alias("text_a"), F.array_join("texts_b", " \u0001b ").alias("text_b"))


def stemmed(both: DataFrame, morph: DataFrame) -> DataFrame:
    """Both texts of each row with base forms for words; marks between texts stay."""
    texts = both.select(F.col("text_a").alias("text")).unionByName(both.select(F.col("text_b").alias("text"))).distinct()
    known = materialize(mp.stem_text(texts, "text", "text", morph, "(\u0001?\\w+)"))
    for side in ("text_a", "text_b"):
        one = known.select(F.col("text").alias(side), "stemmed")
        both = both.join(one, side, "left").withColumn(side, F.coalesce("stemmed", side)).drop("stemmed")
    return both


def phrase_texts(lexicon: Lexicon, pairs: DataFrame, config: Config) -> tuple[DataFrame, list[str]]:
    """The texts of pairs whose phrases are sought, as `joined_texts` has them, and the stop list."""
    stop: list[str] = []
    if config.stop is not None:
        for row in config.stop.select("word").distinct().toLocalIterator():
            stop.append(row["word"])
            if len(stop) > MAX_STOP_WORDS:
                raise ValueError(f"a stop list of over {MAX_STOP_WORDS} words")
    both = joined_texts(lexicon, config.relations, pairs)
    return (stemmed(both, config.stem) if config.stem is not None else both), stop


@measure("lesk", sn.ALL_POS)
def lesk(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """Weighted sum over the relations of the squared lengths of shared phrases."""
    both, stop = phrase_texts(lexicon, pairs, config)
    once = both.select("text_a", "text_b").distinct().withColumn("f", overlap_score(F.col("text_a"), F.col("text_b"), stop, config.normalize))
    return both.join(once, ["text_a", "text_b"]).groupBy(*KEYS).agg(F.sum(F.col("weight") * F.col("f")).alias("score"))


def text_words(texts: DataFrame, text: Column, config: Config, key: str) -> DataFrame:
    """(key, word) of the texts, with compounds joined."""
    flat = texts.select(F.col(key).alias("key"), tx.vector_words(text, config.fold_case).alias("_flat"))
    if config.compounds is not None:
        from relspark.functions.compounds import compoundify

        flat = compoundify(flat, "_flat", config.compounds, "_flat")
    kept = tx.words(F.col("_flat"))
    if config.text_size is not None:
        kept = F.slice(kept, 1, config.text_size + 1)
    found = flat.select("key", F.explode(kept).alias("word"))
    if config.stem is None:
        return found
    known = mp.vector_stem(found, config.stem)
    return found.join(known, "word").select("key", F.col("stem").alias("word"))


@measure("vector", sn.ALL_POS)
def vector(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """Cosine of the summed word vectors of all texts of both concepts. Weights of relations do not count."""
    named, words = concept_words(lexicon, pairs, config)
    context = vec.context_vectors(words, config.vectors, config.stop)
    return vec.cosine(named, context).select(*(F.col(f"_{k}").alias(k) for k in KEYS), "score")


def concept_words(lexicon: Lexicon, pairs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The pairs as _pos_a, .., a, b with keys of concepts, and (key, word) of all texts of each."""
    sides = pairs.select(F.col("pos_a").alias("pos"), F.col("a").alias("id")).unionByName(pairs.select(F.col("pos_b").alias("pos"), F.col("b").alias("id"))).distinct()
    keyed = sides.withColumn("key", F.concat_ws("#", "pos", F.col("id").cast("string")))
    texts = None
    for n, functions in enumerate(config.vector_relations):
        one = rel.compose(lexicon, functions, keyed).select("key", F.struct(F.lit(n).alias("n"), F.array_join("texts", " ").alias("t")).alias("t"))
        texts = one if texts is None else texts.unionByName(one)
    whole = texts.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["t"]), " ").alias("text"))
    named = pairs.select(*KEYS).distinct().select(*(F.col(k).alias(f"_{k}") for k in KEYS), F.concat_ws("#", "pos_a", F.col("a").cast("string")).alias("a"), F.concat_ws("#", "pos_b", F.col("b").cast("string")).alias("b"))
    return named, text_words(whole, F.col("text"), config, "key")


@measure("vector_pairs", sn.ALL_POS)
def vector_pairs(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """Mean over the relations of the cosine of the texts of both sides. Weights do not count."""
    named, words = relation_words(lexicon, pairs, config)
    context = vec.context_vectors(words, config.vectors, config.stop)
    return vec.cosine(named, context).groupBy(*(F.col(f"_{k}").alias(k) for k in KEYS)).agg(F.avg("score").alias("score"))


def relation_words(lexicon: Lexicon, pairs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The pairs as _pos_a, .., rid, a, b with a relation's texts as keys, and (key, word) of each text."""
    both = rel.super_glosses(lexicon, config.relations, pairs).select(*KEYS, "rid", F.array_join("texts_a", " ").alias("text_a"), F.array_join("texts_b", " ").alias("text_b"))
    # Equal texts are one vector, whatever concepts and relations they come from.
    texts = both.select(F.col("text_a").alias("text")).unionByName(both.select(F.col("text_b").alias("text"))).distinct()
    named = both.select(*(F.col(k).alias(f"_{k}") for k in KEYS), "rid", F.col("text_a").alias("a"), F.col("text_b").alias("b"))
    return named, text_words(texts, F.col("text"), config, "text")


@measure("random", sn.ALL_POS)
def random(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """A number that depends on the pair alone, in either order."""
    key = lambda s: F.concat_ws("#", f"pos_{s}", F.col(s).cast("string"))
    return pairs.select(*KEYS).distinct().withColumn("score", tx.pair_random(F.least(key("a"), key("b")), F.greatest(key("a"), key("b")), config.max_random))


def without_root(config: Config) -> Config:
    return replace(config, root_node=False)


def score_words(lexicon: Lexicon, pairs: DataFrame, name: str, config: Config | None = None, morph: DataFrame | None = None, all_senses: bool = False) -> DataFrame:
    """Scores of pairs of words (w1, w2): of every pair of their senses, or of the best one.

    Measures that go by the nodes above the concepts alone score kinds of concepts, not concepts; the best pair of senses is then
    sought among at most four of each two kinds, so it needs no more rows than there are pairs of words and kinds."""
    m, config, pairs = MEASURES[name], config or Config(), materialize(pairs.select("w1", "w2").distinct())
    inputs = pairs.select(F.col("w1").alias("input")).unionByName(pairs.select(F.col("w2").alias("input")))
    senses = sn.lookup(inputs, lexicon.sense, morph, m.pos)
    if name in BY_PARENTS and not config.trace and config.cache is None and config.synset_depths is None:
        return score_kinds(lexicon, pairs, senses, name, config, all_senses)
    scored = score(lexicon, sn.sense_pairs(pairs, senses), name, config)
    return scored if all_senses else sn.best_sense(scored.where("err_level = 0"))


#: Measures whose score of two different concepts without children depends on their parents alone.
BY_PARENTS = ("path", "lch", "wup")


def score_kinds(lexicon: Lexicon, pairs: DataFrame, senses: DataFrame, name: str, config: Config, all_senses: bool) -> DataFrame:
    """What `score_words` gives, by kinds of concepts."""
    senses = materialize(senses)
    kinds = pt.kinds(lexicon.isa, senses)
    known = materialize(join_spread(senses.withColumn("_key", pt.concept_key()), kinds.withColumn("_key", pt.concept_key()).select("_key", "kind", "twin"), "_key").drop("_key"))
    group = ["input", "pos", "kind", "twin"]
    if all_senses:
        of = known.groupBy(group).agg(F.count("*").alias("own"))  # the lists themselves come last
    else:
        once = known.groupBy(*group, "id").agg(F.min(F.struct("wps", "word")).alias("w"))
        of = once.groupBy(group).agg(F.slice(F.array_sort(F.collect_list(F.struct("w.wps", "id", "w.word"))), 1, 2).alias("own"))
    of = materialize(of)
    side = lambda w, s: of.select(F.col("input").alias(w), F.col("pos").alias(f"pos_{s}"), F.col("kind").alias(f"kind_{s}"), F.col("twin").alias(f"twin_{s}"), F.col("own").alias(f"own_{s}"))
    met = pairs.join(side("w1", "a"), "w1").join(side("w2", "b"), "w2")
    # Of two concepts of one kind the least and the greatest stand for any two; one concept alone stands for itself.
    kinship = (F.col("pos_a") == F.col("pos_b")) & (F.col("kind_a") == F.col("kind_b"))
    asked = met.select("pos_a", "kind_a", "pos_b", "kind_b", F.when(kinship, F.col("twin_b")).otherwise(F.col("kind_b")).alias("other")).distinct()
    asked = materialize(asked.select("pos_a", F.col("kind_a").alias("a"), "pos_b", F.explode(F.array_distinct(F.array("kind_b", "other"))).alias("b")).distinct())
    made = materialize(score(lexicon, asked, name, config).select(scored_key("pos_a", "a", "pos_b", "b"), F.struct("score", "err_level", "err_msg").alias("_s")))
    named = lambda rows: rows.select("*", F.inline("own_a").alias("wps1", "a", "word_a")).select("*", F.inline("own_b").alias("wps2", "b", "word_b"))
    columns = ["w1", "w2", "wps1", "pos_a", "a", "word_a", "wps2", "pos_b", "b", "word_b"]
    if all_senses:
        # Scores meet pairs of words and kinds; the senses come last, so that nothing is moved after rows hold them.
        met = materialize(met.withColumn("_kin", kinship))
        alone = materialize(join_spread(met.withColumn("_key", scored_key("pos_a", "kind_a", "pos_b", "kind_b")), made, "_key").withColumnRenamed("_s", "_same"))
        two = materialize(join_spread(alone.withColumn("_key", F.when(F.col("_kin"), scored_key("pos_a", "kind_a", "pos_b", "twin_b"))), made, "_key"))
        return every_sense(two, known)
    found = named(met)
    # Different words of one concept: their kinds' first two senses need not hold it.
    several = known.select("input", "pos", "id").distinct().groupBy("pos", "id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialize(known.join(several, ["pos", "id"], "left_semi").groupBy(*group, "id").agg(F.min(F.struct("wps", "word")).alias("w")))
    one = shared.select(F.col("input").alias("w1"), F.col("pos").alias("pos_a"), F.col("kind").alias("kind_a"), F.col("twin").alias("twin_a"), F.col("w.wps").alias("wps1"), F.col("id").alias("a"), F.col("w.word").alias("word_a"))
    two = shared.select(F.col("input").alias("w2"), F.col("pos").alias("pos_b"), F.col("kind").alias("kind_b"), F.col("twin").alias("twin_b"), F.col("w.wps").alias("wps2"), F.col("id").alias("b"), F.col("w.word").alias("word_b"))
    both = pairs.where("w1 <> w2").join(one, "w1").withColumn("pos_b", F.col("pos_a")).withColumn("b", F.col("a")).join(two, ["w2", "pos_b", "b"])
    kin = ["kind_a", "twin_a", "kind_b", "twin_b"]
    found = found.select(*columns, *kin).unionByName(both.select(*columns, *kin))
    second = F.when(kinship & (F.col("a") != F.col("b")), F.col("twin_b")).otherwise(F.col("kind_b"))
    scored = join_spread(materialize(found.withColumn("_key", scored_key("pos_a", "kind_a", "pos_b", second))), made, "_key")
    return sn.best_sense(scored.select(*columns, "_s.score", "_s.err_level").where("err_level = 0"))


#: Senses of a word in one row; rows of the result that one task makes.
SENSES_A_ROW, ROWS_A_TASK = 4096, 1 << 22


def every_sense(scored: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each sense of w1 with each sense of w2, of the kinds of scored: w1, pos_a, kind_a, own_a, w2, .., with the numbers of senses;
    _same (the score of one concept, or of two kinds) and _s (of two concepts of one kind). A row meets the numbers and ids of both words' senses, some bytes
    each, in lists of bounded length, and becomes pairs of senses after that, in as many tasks as these need: by its bytes Spark would take few. known: input, pos, kind, word, sense, id."""
    part = F.floor(F.col("sense") / SENSES_A_ROW)
    lists = known.groupBy("input", "pos", "kind", "word", part.alias("_part")).agg(F.collect_list(F.struct("sense", "id")).alias("r"))
    lists = materialize(lists.select("input", "pos", "kind", "word", F.col("r.sense").alias("senses"), F.col("r.id").alias("ids")))
    side = lambda w, s: lists.select(F.col("input").alias(w), F.col("pos").alias(f"pos_{s}"), F.col("kind").alias(f"kind_{s}"), F.col("word").alias(f"word_{s}"), F.col("senses").alias(f"senses_{s}"), F.col("ids").alias(f"ids_{s}"))
    n_rows = scored.agg(F.sum(F.col("own_a") * F.col("own_b"))).first()[0] or 0
    dealt = lambda rows: rows.repartition(int(n_rows // ROWS_A_TASK) + 1, "w2", "pos_b", "kind_b")
    both = dealt(scored.join(side("w1", "a"), ["w1", "pos_a", "kind_a"])).join(dealt(side("w2", "b")), ["w2", "pos_b", "kind_b"])
    kept = ["w1", "w2", "pos_a", "word_a", "pos_b", "word_b", "_kin", "_same", "_s"]
    wps = lambda s: F.concat_ws("#", f"word_{s}", f"pos_{s}", F.col("_sense").cast("string"))
    at = lambda s: F.get(f"ids_{s}", F.col("_at")).alias(s)
    one = both.select(*kept, "senses_b", "ids_b", "ids_a", F.posexplode("senses_a").alias("_at", "_sense")).select(*kept, "senses_b", "ids_b", wps("a").alias("wps1"), at("a"))
    every = one.select(*kept, "wps1", "a", "ids_b", F.posexplode("senses_b").alias("_at", "_sense")).select(*kept, "wps1", "a", wps("b").alias("wps2"), at("b"))
    own = F.when(F.col("_kin") & (F.col("a") != F.col("b")), F.col("_s")).otherwise(F.col("_same"))
    return every.withColumn("_s", own).select("w1", "w2", "wps1", "pos_a", "a", "word_a", "wps2", "pos_b", "b", "word_b", "_s.score", "_s.err_level", "_s.err_msg")


def scored_key(pos_a: str, a: str, pos_b: str, b: str | Column) -> Column:
    return F.concat_ws(":", pos_a, F.col(a).cast("string"), pos_b, (F.col(b) if isinstance(b, str) else b).cast("string")).alias("_key")
