"""Readers of lexical database files in the public wndb format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relspark.lexicon import Lexicon

#: Pointer symbols of the format, by part of speech where they differ.
POINTERS = {
    "@": "hype", "@i": "hype", "~": "hypo", "~i": "hypo", "#m": "holo", "#s": "holo", "#p": "holo", "%m": "mero", "%s": "mero", "%p": "mero",
    "=": "attr", "^": "also", "+": "deri", ";c": "domn", ";r": "domn", ";u": "domn", "-c": "domt", "-r": "domt", "-u": "domt",
    "&": "sim", "*": "enta", ">": "caus", "<": "part", "\\": "pert", "!": "ants", "$": "vgrp",
}
FILES = {"n": "noun", "v": "verb", "a": "adj", "r": "adv"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without those of the licence, which begin with a blank. Spark may look into a line's
    fields before it drops the line, so the readers below ask for fields that need not be there."""
    return spark.read.text(path).where("value <> '' and not startswith(value, ' ')")


def plain_pos(pos):
    return F.when(pos == "s", "a").otherwise(pos)


def read_data(spark: SparkSession, folder: str, pos: str) -> DataFrame:
    """(pos, id, words, pointers array<struct<rel, dst, dst_pos, src_no, dst_no>>, gloss) of data.POS."""
    parts = F.split("value", r" \| ?", 2)
    f = F.split(F.trim(F.get(parts, F.lit(0))), " ")
    rows = lines(spark, f"{folder}/data.{FILES[pos]}").select(f.alias("f"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("gloss"))
    n = F.conv(F.get("f", F.lit(3)), 16, 10).cast("int")
    rows = rows.withColumn("n", n).withColumn("p", F.try_element_at("f", F.col("n") * 2 + 5).try_cast("int"))
    word = lambda i: F.regexp_replace(F.try_element_at("f", i * 2 + 5), r"\((?:a|p|ip)\)$", "")
    none = F.array().cast("array<int>")
    counted = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(none)
    names = F.create_map(*(F.lit(x) for kv in POINTERS.items() for x in kv))
    at = lambda i, k: F.try_element_at("f", F.col("n") * 2 + 6 + i * 4 + k)
    pointer = lambda i: F.struct(
        F.try_element_at(names, at(i, 0)).alias("rel"), at(i, 1).try_cast("long").alias("dst"), plain_pos(at(i, 2)).alias("dst_pos"),
        F.conv(F.substring(at(i, 3), 1, 2), 16, 10).cast("int").alias("src_no"), F.conv(F.substring(at(i, 3), 3, 2), 16, 10).cast("int").alias("dst_no"),
    )
    return rows.select(
        F.lit(pos).alias("pos"), F.get("f", F.lit(0)).try_cast("long").alias("id"), F.transform(counted(F.col("n")), word).alias("words"), F.transform(counted(F.col("p")), pointer).alias("pointers"), "gloss",
    )


def read_index(spark: SparkSession, folder: str, pos: str) -> DataFrame:
    """(word, pos, ids): all words of index.POS, with their concepts in the order of their senses."""
    f = F.split(F.trim("value"), " +")
    rows = lines(spark, f"{folder}/index.{FILES[pos]}").select(f.alias("f"))
    return rows.select(F.get("f", F.lit(0)).alias("word"), F.lit(pos).alias("pos"), F.transform(F.slice("f", F.size("f") - F.get("f", F.lit(2)).try_cast("int") + 1, F.get("f", F.lit(2)).try_cast("int")), lambda x: x.try_cast("long")).alias("ids"))


def compounds(words: DataFrame) -> DataFrame:
    """Words with an underscore."""
    return words.where(F.col("word").contains("_")).select("word").distinct()


def read_sense_index(spark: SparkSession, path: str) -> DataFrame:
    """(sense_key, pos, id) of nouns and verbs; zeros before an offset do not count."""
    m = r"^(\S+%([12]):\S*) +([0-9]+)"
    rows = spark.read.text(path).where(F.col("value").rlike(m))
    return rows.select(F.regexp_extract("value", m, 1).alias("sense_key"), F.when(F.regexp_extract("value", m, 2) == "1", "n").otherwise("v").alias("pos"), F.regexp_extract("value", m, 3).cast("long").alias("id"))


def read_cntlist(spark: SparkSession, path: str) -> DataFrame:
    """(count, sense_key) of nouns and verbs."""
    m = r"^([0-9]+) +(\S+%[12]:\S*)"
    return spark.read.text(path).where(F.col("value").rlike(m)).select(F.regexp_extract("value", m, 1).cast("long").alias("count"), F.regexp_extract("value", m, 2).alias("sense_key"))


def read_exceptions(spark: SparkSession, path: str, pos: str) -> DataFrame:
    """(form, pos, lemma) of an exception list."""
    f = F.split(F.trim("value"), " +")
    return spark.read.text(path).where("trim(value) <> ''").select(f[0].alias("form"), F.lit(pos).alias("pos"), F.explode(F.slice(f, F.lit(2), F.size(f))).alias("lemma"))


def read_lexicon(spark: SparkSession, folder: str, poss: tuple[str, ...] = ("n", "v", "a", "r")) -> Lexicon:
    data = index = None
    for pos in poss:
        d, i = read_data(spark, folder, pos), read_index(spark, folder, pos)
        data, index = (d, i) if data is None else (data.unionByName(d), index.unionByName(i))
    synset = data.select("pos", "id", "gloss", "words")
    senses = index.select("word", "pos", F.posexplode("ids").alias("k", "id"))
    named = synset.select("pos", "id", F.posexplode("words").alias("w", "word")).select("pos", "id", F.lower("word").alias("word"), (F.col("w") + 1).alias("word_no"))
    sense = senses.join(named, ["pos", "id", "word"], "left").select("word", "pos", (F.col("k") + 1).alias("sense"), "id", F.coalesce("word_no", F.lit(0)).alias("word_no"))
    pointers = data.select(F.col("pos").alias("src_pos"), F.col("id").alias("src"), "words", F.explode("pointers").alias("p")).where("p.rel is not null")
    targets = synset.select(F.col("pos").alias("dst_pos"), F.col("id").alias("dst"), F.col("words").alias("dst_words"))
    both = pointers.select("p.rel", "src_pos", "src", "p.dst_pos", "p.dst", "words", "p.src_no", "p.dst_no").join(targets, ["dst_pos", "dst"], "left")
    word = lambda ws, no: F.when(F.col(no) > 0, F.lower(F.get(F.col(ws), F.col(no) - 1)))
    edge = both.select("rel", "src_pos", "src", "dst_pos", "dst", word("words", "src_no").alias("src_word"), word("dst_words", "dst_no").alias("dst_word"))
    return Lexicon(synset, sense, edge)
