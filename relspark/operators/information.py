"""Frequencies of concepts, their propagation up the taxonomy, and information content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relspark.lexicon import ROOT, delete, materialize
from relspark.operators.paths import top_nodes


def count_words(tokens: DataFrame, morph: DataFrame, sense: DataFrame, resnik: bool = False) -> DataFrame:
    """(pos, id, freq): for each token (word), one for each sense of each noun and verb lemma of it;
    with resnik, one over the number of senses of the word in that part of speech.

    morph: form, pos, lemma. Tokens are counted first, so that a frequent word is one row.
    """
    words = tokens.groupBy("word").agg(F.count("*").cast("double").alias("n"))
    lemmas = words.join(morph.where("pos in ('n', 'v')").withColumnRenamed("form", "word"), "word").select("word", "n", "pos", "lemma")
    own = sense.where("pos in ('n', 'v')").select(F.col("word").alias("lemma"), "pos", "id").distinct()
    found = lemmas.join(own, ["lemma", "pos"]).select("word", "n", "pos", "id").distinct()
    share = F.col("n") / F.count("*").over(Window.partitionBy("word", "pos")) if resnik else F.col("n")
    return found.withColumn("f", share).groupBy("pos", "id").agg(F.sum("f").alias("freq"))


def add_one(freq: DataFrame, nodes: DataFrame) -> DataFrame:
    """One more for every noun and verb concept."""
    every = nodes.where("pos in ('n', 'v')").select("pos", "id").distinct()
    return every.join(freq, ["pos", "id"], "left").select("pos", "id", (F.coalesce("freq", F.lit(0.0)) + 1.0).alias("freq"))


def propagate(freq: DataFrame, nodes: DataFrame, isa: DataFrame, height: int | None = None) -> DataFrame:
    """(pos, id, freq, is_root): a concept's own frequency and that of each way up to it.

    Ways are counted, not concepts: a concept that reaches an ancestor by two ways counts twice
    there. With a height each level adds up before it climbs on, so the rows of a step are concepts, not ways.
    Without one see `climbed`; a cycle of is-a links is an error then.
    """
    level = freq.groupBy("pos", "id").agg(F.sum("freq").alias("freq"))
    if height is None:
        summed = climbed(level, nodes, isa)
    else:
        total = level
        for _ in range(height):
            up = level.join(isa.withColumnRenamed("child", "id"), ["pos", "id"]).select("pos", F.col("parent").alias("id"), "freq")
            level = up.groupBy("pos", "id").agg(F.sum("freq").alias("freq"))
            total = total.unionByName(level)
        summed = total.groupBy("pos", "id").agg(F.sum("freq").alias("freq"))
    tops = top_nodes(nodes, isa).withColumn("is_root", F.lit(True))
    return (
        nodes.select("pos", "id").distinct().join(summed, ["pos", "id"], "left").join(tops, ["pos", "id"], "left")
        .select("pos", "id", F.coalesce("freq", F.lit(0.0)).alias("freq"), F.coalesce("is_root", F.lit(False)).alias("is_root"))
    )


def climbed(freq: DataFrame, nodes: DataFrame, isa: DataFrame) -> DataFrame:
    """(pos, id, freq): sums over all ways up, for taxonomies of any height.

    With the sums over ways of fewer than n links, and the number of ways of exactly n links between two concepts, one join
    gives the sums over ways of fewer than 2 n; joined with itself, the latter gives those of exactly 2 n. So
    the rounds are as many as the height has binary digits."""
    ways = materialize(isa.groupBy("pos", F.col("child").alias("low"), F.col("parent").alias("high")).agg(F.count("*").cast("double").alias("n")))
    total, links, most = materialize(freq), 1, nodes.select("pos", "id").unionByName(isa.select("pos", F.col("child").alias("id"))).distinct().count()
    while not ways.isEmpty():
        if links > most:
            raise ValueError("is-a links run in a circle")
        up = ways.join(total.withColumnRenamed("id", "low"), ["pos", "low"]).select("pos", F.col("high").alias("id"), (F.col("freq") * F.col("n")).alias("freq"))
        last_total, total = total, materialize(total.unionByName(up).groupBy("pos", "id").agg(F.sum("freq").alias("freq")))
        ahead = ways.select("pos", F.col("low").alias("high"), F.col("high").alias("_high"), F.col("n").alias("_n"))
        last_ways, ways = ways, materialize(ways.join(ahead, ["pos", "high"]).groupBy("pos", "low", F.col("_high").alias("high")).agg(F.sum(F.col("n") * F.col("_n")).alias("n")))
        links *= 2
        delete(last_total)
        delete(last_ways)
    return total


def root_frequency(counts: DataFrame) -> DataFrame:
    """pos, root_freq: the sum over the roots."""
    return counts.where("is_root").groupBy("pos").agg(F.sum("freq").alias("root_freq"))


def share_of(freq: Column, root_freq: Column) -> Column:
    return F.coalesce(F.try_divide(freq, root_freq), F.lit(0.0))


def ic_of(p: Column) -> Column:
    """Information of a share of the root's frequency."""
    return F.when((p > 0) & (p <= 1), -F.ln(F.when(p > 0, p).otherwise(1.0))).otherwise(0.0) + 0.0


def information(counts: DataFrame) -> DataFrame:
    """pos, id, freq, prob, ic, root_freq, err_level. A concept without frequency has no
    information, as has the virtual root; a probability above one is an error and counts as 0."""
    rows = counts.select("pos", "id", "freq").join(F.broadcast(root_frequency(counts)), "pos")  # a row for each part of speech
    virtual = root_frequency(counts).select("pos", F.lit(ROOT).cast("long").alias("id"), F.col("root_freq").alias("freq"), "root_freq")
    whole = rows.unionByName(virtual).withColumn("p", share_of(F.col("freq"), F.col("root_freq")))
    prob = F.when(F.col("p") > 1, 0.0).otherwise(F.col("p"))
    return whole.select(
        "pos", "id", "freq", prob.alias("prob"),
        ic_of(F.col("p")).alias("ic"),
        "root_freq", F.when(F.col("p") > 1, 2).otherwise(0).alias("err_level"),
    )


def sense_tag_counts(cntlist: DataFrame, sense_index: DataFrame) -> DataFrame:
    """(pos, id, freq): sum of the tag counts of a concept's sense keys. cntlist: count, sense_key; sense_index: sense_key, pos, id."""
    return cntlist.join(sense_index, "sense_key").where("pos in ('n', 'v')").groupBy("pos", "id").agg(F.sum(F.col("count").cast("double")).alias("freq"))
