"""What a score is made of: for each measure rows from which its score can be worked out again.

``provenance(lexicon, pairs, name, config)`` gives them as columns, and `score` as worked out from them alone; ``texts`` gives
one string for each pair, which ``measures.score`` adds with ``Config(trace=True)``. A new measure's is registered with ``trace``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from relspark.functions.overlap import shared_phrases
from relspark.lexicon import Lexicon, materialize
from relspark.operators import paths as pt, senses as sn, vectors as vec, walks
from relspark.plans import measures as ms
from relspark.plans.measures import KEYS, Config


@dataclass(frozen=True)
class Trace:
    rows: Callable[[Lexicon, DataFrame, Config], DataFrame]
    text: Callable[[], Column]


TRACES: dict[str, Trace] = {}


def trace(name: str, text: Callable[[], Column]):
    """Registers a function (lexicon, pairs, config) -> KEYS, columns, score; text makes a line of a row's columns."""

    def add(rows):
        TRACES[name] = Trace(rows, text)
        return rows

    return add


def provenance(lexicon: Lexicon, pairs: DataFrame, name: str, config: Config | None = None) -> DataFrame:
    """The rows of pairs (pos_a, a, pos_b, b, and word_a, word_b or within for hso). Pairs without a score, or of parts of speech that the
    measure does not know, have none. Equal pairs have one row; lesk and vector_pairs one for each relation."""
    if name not in TRACES:
        raise ValueError(f"no trace of {name!r}; there are {', '.join(sorted(TRACES))}")
    pos = ms.MEASURES[name].pos
    fit = pairs.where(F.col("pos_a").isin(*pos) & F.col("pos_b").isin(*pos))
    if pos == sn.NOUN_VERB:
        fit = fit.where("pos_a = pos_b")
    return TRACES[name].rows(lexicon, fit.select(*KEYS, *(c for c in ms.WORDS if c in pairs.columns)).distinct(), config or Config())


def texts(lexicon: Lexicon, pairs: DataFrame, name: str, config: Config) -> DataFrame:
    """KEYS, trace: the ways between the concepts, for measures on the taxonomy, then lines of what `provenance` gives, in order."""
    rows = provenance(lexicon, pairs, name, config)
    keys = [*KEYS, *(c for c in ms.WORDS if c in pairs.columns and name == "hso")]
    lines = rows.select(*keys, TRACES[name].text().alias("line")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("trace"))
    if ms.MEASURES[name].pos != sn.NOUN_VERB:
        return lines
    told = ways(lexicon, pairs, config).join(lines, KEYS, "left")
    return told.select(*KEYS, F.concat_ws("\n", "ways", F.when(F.col("trace") != "", F.col("trace"))).alias("trace"))


def ways(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """KEYS, ways: every way from a to b as `nodes (len)`, shortest first."""
    p = ms.same_pos(pairs.select(*KEYS).distinct())
    way = F.format_string("%s (%d)", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">"), "len")
    every = pt.all_paths(p, ms.member_paths(lexicon, p, config)).groupBy("pos", "a", "b").agg(F.array_sort(F.collect_set(F.struct("len", way.alias("w")))).alias("ws"))
    return by_both_pos(every, F.array_join(F.transform("ws", lambda x: x["w"]), "; ").alias("ways"))


def by_both_pos(rows: DataFrame, *columns: Column | str) -> DataFrame:
    return rows.select(F.col("pos").alias("pos_a"), "a", F.col("pos").alias("pos_b"), "b", *columns)


def best(rows: DataFrame, score: Column, *columns: str) -> DataFrame:
    """Of each pair the row of the highest score, ties to the smaller subsumer."""
    first = F.min(F.struct((-score).alias("s"), "subsumer", *columns)).alias("m")
    return by_both_pos(rows.groupBy("pos", "a", "b").agg(first), "m.subsumer", *(f"m.{c}" for c in columns), (F.lit(0.0) - F.col("m.s")).alias("score"))


@trace("path", lambda: F.lit(""))  # its ways say it all
def path(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """len, the nodes on the shortest way."""
    p = ms.same_pos(pairs)
    return by_both_pos(pt.path_lengths(p, ms.member_paths(lexicon, p, config)), "len", (1.0 / F.col("len")).alias("score"))


@trace("lch", lambda: F.format_string("subsumer %d, nodes %d, depth of taxonomy %d", "subsumer", "len", "depth"))
def lch(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """subsumer, len, depth: of the deepest taxonomy among those of subsumers on shortest ways."""
    if config.root_node and lexicon.height is not None:
        # All subsumers are of one taxonomy, so of those on shortest ways the smallest is told: a pair stays one row.
        p = ms.same_pos(pairs)
        found = pt.joint_nodes(p, ms.member_paths(lexicon, p, config), "one").join(F.broadcast(ms.rooted_depth(lexicon, config).where("d > 0")), "pos")
        length = F.col("la") + F.col("lb") - 1
        return by_both_pos(found, "subsumer", length.alias("len"), F.col("d").alias("depth"), (F.ln(2.0 * F.col("d") / length) + F.lit(0.0)).alias("score"))
    rows = ms.shortest_in_taxonomies(lexicon, pairs, config).where("d > 0").withColumnRenamed("d", "depth")
    return best(rows, F.ln(2.0 * F.col("depth") / F.col("len")), "len", "depth")


@trace("wup", lambda: F.format_string("subsumer %d, depth %d, nodes up to it %d and %d", "subsumer", "depth", "la", "lb"))
def wup(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """subsumer, depth, la, lb: the deepest subsumer, and the nodes on the shortest ways to it."""
    return best(ms.deepest_with_ways(lexicon, pairs, config), ms.depth_ratio(), "depth", "la", "lb")


INFORMED = ["subsumer", "ic_l", "ic_a", "ic_b", "freq_l", "freq_a", "freq_b", "root_freq"]


def informed(formula: Callable[[], Column]):
    def rows(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
        """subsumer, information and frequencies of it and of both concepts, and the root's frequency."""
        return by_both_pos(ms.informed(lexicon, pairs, config), *INFORMED, formula().alias("score"))

    return rows


def informed_text() -> Column:
    return F.format_string("subsumer %d: %.6f of %s; a: %.6f of %s; b: %.6f of %s; root of %s", "subsumer", "ic_l", F.col("freq_l").cast("string"), "ic_a", F.col("freq_a").cast("string"), "ic_b", F.col("freq_b").cast("string"), F.col("root_freq").cast("string"))


for _name, _formula in (("res", ms.res_of), ("lin", ms.lin_of), ("jcn", ms.jcn_of)):
    trace(_name, informed_text)(informed(_formula))


def walk_text() -> Column:
    links = F.array_join(F.transform("way", lambda x: F.concat(x["dir"], F.lit(" "), x["pos"], F.lit("#"), x["id"].cast("string"))), " ")
    start = F.concat(F.col("pos_a"), F.lit("#"), F.col("a").cast("string"))
    return F.concat_ws(": ", F.substring("kind", 3, 100), F.when(F.col("way").isNotNull(), F.concat_ws(" ", start, links)))


@trace("hso", walk_text)
def hso(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """word_a, word_b (or within), kind and way: the strong link, or the links of one best walk."""
    return walks.provenance(pairs, walks.links(lexicon.edge, lexicon.sense))


@trace("lesk", lambda: F.format_string("relation %d, weight %s, words %d and %d: %s", "rid", F.col("weight").cast("string"), "words_a", "words_b", F.array_join("phrases", " | ")))
def lesk(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """rid, weight, words_a, words_b, phrases and score of each relation; a pair's score is their sum."""
    both, stop = ms.phrase_texts(lexicon, pairs, config)
    once = both.select("text_a", "text_b").distinct().withColumn("_f", shared_phrases(F.col("text_a"), F.col("text_b"), stop))
    # A mark between texts is a word of its own, which no phrase holds.
    squares = F.aggregate("phrases", F.lit(0.0), lambda s, p: s + F.pow(F.size(F.split(p, " ")).cast("double"), F.lit(2.0)))
    score = F.col("weight") * (squares / F.greatest(F.col("words_a").cast("long") * F.col("words_b"), F.lit(1)) if config.normalize else squares)
    return both.join(once, ["text_a", "text_b"]).select(*KEYS, "rid", "weight", "_f.*").withColumn("score", score)


def product_text() -> Column:
    return F.format_string("product %.6f, lengths %.6f and %.6f, words: %s; %s", "dot", "na", "nb", F.array_join("words_a", " "), F.array_join("words_b", " "))


def product_rows(named: DataFrame, words: DataFrame, config: Config, *more: str) -> DataFrame:
    """dot, na, nb, words_a, words_b: the product of both vectors, their lengths, and the words that have vectors."""
    found = vec.set_products(named, words, config.vectors, config.stop)
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dot", "na", "nb")]
    none = [F.coalesce(f"words_{s}", F.array().cast("array<string>")).alias(f"words_{s}") for s in "ab"]
    rows = found.select(*(F.col(f"_{k}").alias(k) for k in KEYS), *more, *zero, *none)
    return rows.withColumn("score", F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.col("na") * F.col("nb"))).otherwise(0.0))


@trace("vector", product_text)
def vector(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    return product_rows(*ms.concept_words(lexicon, pairs, config), config)


@trace("vector_pairs", lambda: F.concat(F.format_string("relation %d, ", "rid"), product_text()))
def vector_pairs(lexicon: Lexicon, pairs: DataFrame, config: Config) -> DataFrame:
    """A row for each relation, with rid; a pair's score is their mean."""
    return product_rows(*ms.relation_words(lexicon, pairs, config), config, "rid")
