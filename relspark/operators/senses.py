"""Checks of sense strings and pairs, lookup of words, and the choice among senses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relspark.lexicon import UNRELATED
from relspark.operators.joins import join_spread, running_total

NOUN_VERB = ("n", "v")
ALL_POS = ("n", "v", "a", "r")


def parse(wps: Column) -> dict[str, Column]:
    """The parts of word#pos#sense; a missing part is null."""
    parts = F.split(wps, "#")
    return {"word": F.get(parts, F.lit(0)), "pos": F.get(parts, F.lit(1)), "sense": F.get(parts, F.lit(2)), "n": F.size(parts)}


def validate(df: DataFrame, wps: str, sense: DataFrame) -> DataFrame:
    """df with id, err_level and err_msg for a column of sense strings. Each fault has level 1."""
    p = parse(F.col(wps))
    shown = F.concat(F.lit("("), F.coalesce(F.col(wps), F.lit("")), F.lit(")"))
    fault = (
        F.when(F.col(wps).isNull() | (F.col(wps) == ""), F.lit("Undefined input sense."))
        .when(p["word"] == "", F.concat(F.lit("No word in sense "), shown, F.lit(".")))
        .when(p["pos"].isNull() | (p["pos"] == ""), F.concat(F.lit("No part of speech in sense "), shown, F.lit(".")))
        .when(p["sense"].isNull() | (p["sense"] == ""), F.concat(F.lit("No sense number in sense "), shown, F.lit(".")))
        .when(p["n"] > 3, F.concat(F.lit("Too many parts in sense "), shown, F.lit(".")))
        .when(~p["pos"].rlike("^[nvar]$"), F.concat(F.lit("Bad part of speech in sense "), shown, F.lit(".")))
        .when(~p["sense"].rlike("^[0-9]+$"), F.concat(F.lit("Bad sense number in sense "), shown, F.lit(".")))
    )
    known = sense.select(F.col("word").alias("_w"), F.col("pos").alias("_p"), F.col("sense").cast("bigint").alias("_s"), F.col("id").alias("_id"))
    number = F.when(fault.isNull(), p["sense"].try_cast("bigint"))
    keyed = df.withColumn("_fault", fault).withColumn("_n", number)
    q = {k: v for k, v in p.items()}
    joined = keyed.join(known, (q["word"] == F.col("_w")) & (q["pos"] == F.col("_p")) & (F.col("_n") == F.col("_s")), "left")
    missing = F.when(F.col("_id").isNull(), F.concat(F.lit("Sense "), shown, F.lit(" is not in the lexicon.")))
    message = F.coalesce("_fault", missing)
    return joined.select(*df.columns, F.when(message.isNull(), F.col("_id")).alias("id"), F.when(message.isNull(), 0).otherwise(1).alias("err_level"), message.alias("err_msg"))


def validate_pairs(df: DataFrame, sense: DataFrame, left: str = "wps1", right: str = "wps2") -> DataFrame:
    """df with id_a, id_b, err_level and err_msg for two columns of sense strings. Both are checked;
    the message is the left one's, else the right one's, and with a fault neither has an id. A
    missing or empty string on either side is the first fault of all."""
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), F.col(left).alias("_left"), F.col(right).alias("_right"))
    one = validate(whole, "_left", sense).withColumnsRenamed({"id": "_a", "err_level": "_la", "err_msg": "_ma"})
    both = validate(one, "_right", sense)
    void = F.coalesce(F.col("_right"), F.lit("")) == ""
    message = F.when(void & (F.coalesce(F.col("_left"), F.lit("")) != ""), F.col("err_msg")).otherwise(F.coalesce("_ma", "err_msg"))
    level = F.greatest("_la", "err_level")
    return both.select("_row.*", F.when(level == 0, F.col("_a")).alias("id_a"), F.when(level == 0, F.col("id")).alias("id_b"), level.alias("err_level"), message.alias("err_msg"))


def well_formed(wps: Column) -> Column:
    """The looser check of walks and vectors: anything without blanks, a part of speech, a number."""
    return F.coalesce(wps.rlike(r"^\S+#[nvar]#[0-9]+$"), F.lit(False))


def canonical(df: DataFrame, sense: DataFrame, pos: str = "pos", id_: str = "id") -> DataFrame:
    """df with wps: the first sense of each concept (pos, id)."""
    first = sense.where("word_no = 1").select(F.col("pos").alias("_p"), F.col("id").alias("_i"), F.concat_ws("#", "word", "pos", F.col("sense").cast("string")).alias("wps"))
    return df.join(first, (F.col(pos) == F.col("_p")) & (F.col(id_) == F.col("_i")), "left").drop("_p", "_i")


def pair_status(pos_a: Column, pos_b: Column, allowed: tuple[str, ...] = NOUN_VERB) -> tuple[Column, Column, Column]:
    """(fixed score, err_level, err_msg) of a pair by its parts of speech. First of all they must be
    the same: if not, the pair is unrelated. Then the measure must know them: if not, there is no score."""
    other, unknown = pos_a != pos_b, ~pos_a.isin(*allowed)
    return (
        F.when(other, F.lit(UNRELATED)),
        F.when(other | unknown, 1).otherwise(0),
        F.when(other, F.concat(pos_a, F.lit(" and "), pos_b, F.lit(" are different parts of speech.")))
        .when(unknown, F.concat(pos_a, F.lit(" is a part of speech that the measure does not know."))),
    )


def distinct_errors(df: DataFrame, message: str = "err_msg") -> DataFrame:
    """Messages once each; those about two parts of speech once for both orders."""
    sides = F.array_sort(F.split(F.regexp_extract(message, r"^(\w and \w) are", 1), " and "))
    key = F.when(F.col(message).rlike(r"^\w and \w are"), F.array_join(sides, " and ")).otherwise(F.col(message))
    return df.where(F.col(message).isNotNull()).withColumn("_k", key).groupBy("_k").agg(F.min(message).alias(message)).drop("_k")


def lookup(words: DataFrame, sense: DataFrame, morph: DataFrame | None = None, allowed: tuple[str, ...] = ALL_POS) -> DataFrame:
    """(input, wps, word, pos, sense, id): the senses of inputs `word`, `word#pos` (several letters name
    several parts of speech) or `word#pos#sense`.

    An exact sense stands for itself. Else all senses in the parts of speech, and only where there
    are none those of the base forms (morph: form, pos, lemma; the first of each part of speech).
    """
    p = parse(F.col("input"))
    letters = F.when(p["pos"].isNull() | (p["pos"] == ""), F.array(*map(F.lit, ALL_POS))).otherwise(F.split(p["pos"], ""))
    asked = words.select("input").where("input is not null").distinct().select(
        "input", F.lower(F.translate(p["word"], " ", "_")).alias("_w"), F.explode(F.filter(letters, lambda x: x.isin(*allowed))).alias("pos"), p["sense"].try_cast("int").alias("_s")
    )
    own = sense.select(F.col("word").alias("_w"), "pos", "sense", "id")
    found = asked.join(own, ["_w", "pos"]).where("_s is null or _s = sense")
    if morph is not None:
        none = asked.join(found.select("input").distinct(), "input", "left_anti")
        base = morph.groupBy("form", "pos").agg(F.min("lemma").alias("lemma"))
        other = none.join(base, (none["_w"] == base["form"]) & (none["pos"] == base["pos"])).select("input", F.col("lemma").alias("_w"), none["pos"], "_s")
        found = found.unionByName(other.join(own, ["_w", "pos"]).where("_s is null or _s = sense"))
    return found.select("input", F.concat_ws("#", "_w", "pos", F.col("sense").cast("string")).alias("wps"), F.col("_w").alias("word"), "pos", "sense", "id").distinct()


def all_forms(words: DataFrame, sense: DataFrame, morph: DataFrame) -> DataFrame:
    """The lookup of the request service: all base forms, then all senses of each."""
    forms = words.select(F.col("input"), F.lower("input").alias("form")).distinct().join(morph, "form").select("input", F.col("lemma").alias("word"), "pos").distinct()
    return forms.join(sense, ["word", "pos"]).select("input", F.concat_ws("#", "word", "pos", F.col("sense").cast("string")).alias("wps"), "word", "pos", "sense", "id")


def sense_pairs(pairs: DataFrame, senses: DataFrame) -> DataFrame:
    """(w1, w2, wps1, pos_a, a, word_a, wps2, pos_b, b, word_b): every sense of w1 with every sense of w2."""
    left = senses.select(F.col("input").alias("w1"), F.col("wps").alias("wps1"), F.col("pos").alias("pos_a"), F.col("id").alias("a"), F.col("word").alias("word_a"))
    right = senses.select(F.col("input").alias("w2"), F.col("wps").alias("wps2"), F.col("pos").alias("pos_b"), F.col("id").alias("b"), F.col("word").alias("word_b"))
    return pairs.select("w1", "w2").distinct().join(left, "w1").join(right, "w2")


def best_sense(scored: DataFrame) -> DataFrame:
    """For each (w1, w2) the pair of senses of the highest score, with its trace if there is one; ties to the smaller sense strings."""
    trace = [c for c in ("trace",) if c in scored.columns]
    first = F.min(F.struct((-F.col("score")).alias("s"), "wps1", "wps2", *trace)).alias("m")
    return scored.where("score is not null").groupBy("w1", "w2").agg(first).select("w1", "w2", "m.wps1", "m.wps2", (-F.col("m.s") + 0.0).alias("score"), *(f"m.{c}" for c in trace))


def drop_stop_words(tokens: DataFrame, stop: DataFrame, word: str = "word") -> DataFrame:
    return tokens.join(stop.select(F.col("word").alias(word)).distinct(), word, "left_anti")


def drop_stop_compounds(tokens: DataFrame, stop: DataFrame, key: str, word: str = "word") -> DataFrame:
    """Tokens of which all parts between underscores are stop words go. key names a token."""
    parts = tokens.select(key, F.explode(F.filter(F.split(word, "_+"), lambda x: x != "")).alias("_part"))
    keep = parts.join(stop.select(F.col("word").alias("_part")).distinct(), "_part", "left_anti").select(key).distinct()
    return tokens.join(keep, key, "left_semi")


def rank_pairs(scored: DataFrame, digits: int = 2) -> DataFrame:
    """(w1, w2, score, rank): competition ranks (1, 1, 3) of scores rounded to `digits`, highest first.

    Ranks come from the number of pairs of each rounded score, added up over ranges of scores; neither many
    distinct scores nor a score that many pairs share is one task's."""
    rows = scored.select("w1", "w2", F.round("score", digits).alias("score"))
    sizes = rows.groupBy("score").agg(F.count("*").alias("n"))
    # A null score as a key: whether there is one, and it.
    key = F.concat_ws(":", F.col("score").isNull().cast("string"), F.col("score").cast("string"))
    ranks = running_total(sizes, F.col("n"), [F.desc_nulls_last("score")], "above").select(key.alias("_key"), (F.col("above") + 1).alias("rank"))
    return join_spread(rows.withColumn("_key", key), ranks, "_key").select("w1", "w2", "score", "rank")


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, rho: correlation of the mean ranks that two scorings (w1, w2, score) give the same pairs."""
    def mean_ranks(df: DataFrame, name: str) -> DataFrame:
        ranked = rank_pairs(df, 12)
        size = ranked.groupBy("rank").agg(F.count("*").alias("n"))
        return join_spread(ranked, size, "rank").select("w1", "w2", (F.col("rank") + (F.col("n") - 1) / 2).alias(name))

    return mean_ranks(a, "x").join(mean_ranks(b, "y"), ["w1", "w2"]).agg(F.corr("x", "y").alias("rho"))
