"""Relations of concepts as joins, the texts of concepts, and compositions of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from relspark.functions import text as tx
from relspark.lexicon import Lexicon

#: Relations of whole concepts, relations between words, and functions from concepts to text.
CONCEPT_RELATIONS = ("hype", "hypo", "holo", "mero", "attr", "sim", "enta", "caus")
WORD_RELATIONS = ("also", "deri", "domn", "domt", "part", "pert", "ants")
TEXT_FUNCTIONS = ("glos", "example", "glosexample", "syns")
#: Types of arguments and results: 1 a set of concepts, 2 a text.
TYPES = {**{r: (1, 1) for r in (*CONCEPT_RELATIONS, *WORD_RELATIONS)}, **{t: (1, 2) for t in TEXT_FUNCTIONS}}


def expand(lexicon: Lexicon, rel: str, concepts: DataFrame) -> DataFrame:
    """(key, pos, id) or, for relations between words, (key, pos, id, word): for each key the distinct concepts
    that its concepts (key, pos, id, perhaps word) are related to, and the word that is reached there.

    Relations between words are those of one word of a concept: of column `word`, if concepts have it and it is
    not null, else of the concept's first word. So in a composition each step goes on from the word that the
    last one reached; one between whole concepts reaches the first word."""
    if rel not in TYPES or TYPES[rel][1] != 1:
        raise ValueError(f"no relation {rel!r}")
    edge = lexicon.edge.where(F.col("rel") == rel).select(F.col("src_pos").alias("pos"), F.col("src").alias("id"), "src_word", F.col("dst_pos").alias("_p"), F.col("dst").alias("_i"), F.col("dst_word").alias("_w"))
    if rel not in WORD_RELATIONS:
        return concepts.join(edge, ["pos", "id"]).select("key", F.col("_p").alias("pos"), F.col("_i").alias("id")).distinct()
    first = lexicon.sense.where("word_no = 1").select("pos", "id", F.col("word").alias("_first")).distinct()
    own = F.coalesce(*(["word"] if "word" in concepts.columns else []), "_first")
    met = concepts.join(first, ["pos", "id"], "left").withColumn("_own", own).join(edge, ["pos", "id"])
    met = met.where(F.col("src_word").isNull() | (F.lower("src_word") == F.lower("_own")))
    return met.select("key", F.col("_p").alias("pos"), F.col("_i").alias("id"), F.col("_w").alias("word")).distinct()


def texts(lexicon: Lexicon, function: str, concepts: DataFrame) -> DataFrame:
    """(key, texts): for each key the texts of its concepts, in the order of their ids.

    glos: the definition without examples. example: the quoted examples. glosexample: both.
    syns: the words, sorted. All but syns are cleaned and in lower case. Texts stay elements of
    an array, so that no phrase reaches from one to the next.
    """
    gloss = F.coalesce(F.col("gloss"), F.lit(""))
    parts = {
        "glos": F.array(tx.clean(tx.definition(gloss))),
        "example": F.transform(tx.examples(gloss), tx.clean),
        "glosexample": F.array(tx.clean(gloss)),
        "syns": F.array(F.array_join(F.array_sort(F.array_distinct(F.transform("words", lambda w: F.translate(w, " ", "_")))), " ")),
    }
    if function not in parts:
        raise ValueError(f"no text function {function!r}")
    own = concepts.select("key", "pos", "id").distinct().join(lexicon.synset.select("pos", "id", "gloss", "words"), ["pos", "id"])
    made = own.select("key", "pos", "id", F.filter(parts[function], lambda t: t != "").alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id", "t")))
    return made.groupBy("key").agg(F.flatten(F.transform(ordered, lambda s: s["t"])).alias("texts"))


def check_types(functions: list[str]) -> list[str]:
    """functions from the innermost out; a set of concepts at the end is wrapped into glos."""
    for f in functions:
        if f not in TYPES:
            raise ValueError(f"no function {f!r}")
    for inner, outer in zip(functions, functions[1:]):
        if TYPES[inner][1] != TYPES[outer][0]:
            raise ValueError(f"{outer}({inner}) is no valid combination")
    return functions if functions and TYPES[functions[-1]][1] == 2 else [*functions, "glos"]


def compose(lexicon: Lexicon, functions: list[str], concepts: DataFrame) -> DataFrame:
    """(key, texts) of a composition such as example(hype(hype)), given from the innermost out."""
    *relations, last = check_types(functions)
    return texts(lexicon, last, reduce(lambda frame, rel: expand(lexicon, rel, frame), relations, concepts))


def super_glosses(lexicon: Lexicon, relations: list[tuple[list[str], list[str], float]], pairs: DataFrame) -> DataFrame:
    """(pos_a, a, pos_b, b, rid, weight, texts_a, texts_b): for each pair and relation the texts of both
    sides. Each side is made once for each concept and composition, however many pairs or lines need it."""
    def keyed(side: str) -> DataFrame:
        return pairs.select(F.col(f"pos_{side}").alias("pos"), F.col(side).alias("id")).distinct().withColumn("key", F.struct("pos", "id"))

    made: dict[tuple[str, tuple], DataFrame] = {}

    def side(name: str, functions: list[str]) -> DataFrame:
        at = (name, tuple(functions))
        if at not in made:
            made[at] = compose(lexicon, functions, keyed(name)).select(F.col("key.pos").alias(f"pos_{name}"), F.col("key.id").alias(name), F.col("texts").alias(f"texts_{name}"))
        return made[at]

    none = F.array().cast("array<string>")
    own = pairs.select("pos_a", "a", "pos_b", "b").distinct()
    lines = []
    for rid, (left, right, weight) in enumerate(relations):
        both = own.join(side("a", left), ["pos_a", "a"], "left").join(side("b", right), ["pos_b", "b"], "left")
        lines.append(both.select("pos_a", "a", "pos_b", "b", F.lit(rid).alias("rid"), F.lit(float(weight)).alias("weight"), F.coalesce("texts_a", none).alias("texts_a"), F.coalesce("texts_b", none).alias("texts_b")))
    return reduce(DataFrame.unionByName, lines)
