"""Word vectors by co-occurrence in documents, and similarity of texts by the sum of their words' vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from relspark.lexicon import materialize
from relspark.operators.joins import hot_keys, join_spread


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """(word, tf, df) of tokens (doc, word)."""
    per_doc = tokens.groupBy("doc", "word").agg(F.count("*").alias("n"))  # so that no count of distinct documents is needed
    return per_doc.groupBy("word").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def tf_idf(terms: DataFrame, n_docs: float) -> DataFrame:
    """terms with tfidf: tf x ln(documents / df)."""
    return terms.withColumn("tfidf", F.col("tf") * F.ln(F.lit(float(n_docs)) / F.col("df")))


def cooccurrence(tokens: DataFrame) -> DataFrame:
    """(w1, w2, cnt): ordered pairs of tokens of one document, each with itself too, so a word that
    stands k times adds k x k to its own. Documents are meant to be short, like definitions: their
    pairs are made in the document's row, from counts, one for each two distinct words. No join is needed, whose
    side could be taken for small by the size of a well compressed file, and be sent to the driver."""
    counts = tokens.groupBy("doc", "word").agg(F.count("*").alias("n"))
    lists = counts.groupBy("doc").agg(F.collect_list(F.struct("word", "n")).alias("ws"))
    made = lists.select("ws", F.inline("ws")).select(F.col("word").alias("w1"), F.col("n").alias("n1"), F.inline("ws"))
    return made.groupBy("w1", F.col("word").alias("w2")).agg(F.sum(F.col("n1") * F.col("n")).alias("cnt"))


def build_vectors(
    tokens: DataFrame, n_docs: int, stop: DataFrame | None = None, chigh: int | None = None, clow: int | None = None,
    rhigh: int | None = None, rlow: int | None = None, cutoff: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """dims (word, tf, df) and vectors (word, dim, cnt); a dimension is named by its word.

    Bounds on the frequency of dimensions (chigh, clow) and of rows (rhigh, rlow); with a cutoff,
    words of a higher tf-idf are no dimensions.
    """
    if stop is not None:
        tokens = tokens.join(stop.select("word").distinct(), "word", "left_anti")
    terms = term_frequencies(tokens)
    dims = terms
    if chigh is not None:
        dims = dims.where(F.col("tf") <= chigh)
    if clow is not None:
        dims = dims.where(F.col("tf") >= clow)
    if cutoff is not None:
        dims = tf_idf(dims, n_docs).where(F.col("tfidf") <= cutoff).drop("tfidf")
    rows = terms
    if rhigh is not None:
        rows = rows.where(F.col("tf") <= rhigh)
    if rlow is not None:
        rows = rows.where(F.col("tf") >= rlow)
    made = cooccurrence(tokens).join(dims.select(F.col("word").alias("w2")), "w2", "left_semi").join(rows.select(F.col("word").alias("w1")), "w1", "left_semi")
    return dims, made.select(F.col("w1").alias("word"), F.col("w2").alias("dim"), "cnt")


#: Cells of the vectors of frequent words that are sent to all tasks together, some tens of bytes each.
PACK_CELLS = 1 << 18


def context_vectors(texts: DataFrame, vectors: DataFrame, stop: DataFrame | None = None, pack_cells: int = PACK_CELLS) -> DataFrame:
    """(key, dim, v): sum of the vectors of the distinct words of each text. texts: key, word.

    It is a product of two sparse tables. Words of at least one in HOT of all words of texts, HOT words at most, are multiplied
    where the texts are: their vectors come in packs of bounded size, and each text's sum over all of them is made
    in its task, so that what is moved grows with the sums and not with a word's frequency times its dimensions. The vectors
    of all other words meet the texts by a join on the word, of which none is hot.
    """
    kinds = texts.select("key", "word").distinct()
    if stop is not None:
        kinds = kinds.join(stop.select("word").distinct(), "word", "left_anti")
    kinds = materialize(kinds.repartition("key"))
    hot = materialize(hot_keys(kinds, "word", kinds.count()))
    cells = materialize(vectors.select("word", "dim", F.col("cnt").cast("double").alias("cnt")).join(F.broadcast(hot), "word", "left_semi"))
    n_packs = max(1, -(-cells.count() // pack_cells))
    # Of one text all words are in one task, so its sums need no exchange of their own.
    frequent = kinds.join(F.broadcast(hot), "word", "left_semi").repartition("key")
    packs = [frequent.join(F.broadcast(cells.where(F.pmod(F.xxhash64("word", "dim"), F.lit(n_packs)) == k)), "word").groupBy("key", "dim").agg(F.sum("cnt").alias("v")) for k in range(n_packs)]
    rare = kinds.join(F.broadcast(hot), "word", "left_anti").join(vectors, "word").select("key", "dim", F.col("cnt").cast("double").alias("v"))
    return reduce(DataFrame.unionByName, [*packs, rare]).groupBy("key", "dim").agg(F.sum("v").alias("v"))


def norms(context: DataFrame) -> DataFrame:
    return context.groupBy("key").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def packed(context: DataFrame) -> DataFrame:
    """(key, vec, norm): each vector as a map, so that a pair of texts is one row."""
    return context.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("vec"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def products(pairs: DataFrame, context: DataFrame) -> DataFrame:
    """pairs (a, b, ..) with dot, na, nb: the product of the vectors of keys a and b and their lengths; null without one."""
    vec = packed(context)
    left = vec.select(F.col("key").alias("a"), F.col("vec").alias("va"), F.col("norm").alias("na"))
    right = vec.select(F.col("key").alias("b"), F.col("vec").alias("vb"), F.col("norm").alias("nb"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    few, many = F.when(F.size("va") <= F.size("vb"), F.col("va")).otherwise(F.col("vb")), F.when(F.size("va") <= F.size("vb"), F.col("vb")).otherwise(F.col("va"))
    dot = F.aggregate(F.map_entries("few"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(F.col("many"), e["key"]), F.lit(0.0)))
    return joined.withColumn("few", few).withColumn("many", many).select(*pairs.columns, dot.alias("dot"), "na", "nb")


def set_products(pairs: DataFrame, texts: DataFrame, vectors: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """pairs (a, b, ..) without a and b, with what `products` gives for their texts (key, word), and words_a, words_b: the words that have vectors; null without any.

    Texts of the same words are one: vectors and products are made once for each set of words and each two sets, and
    a pair brings two numbers to them, no vector and no text."""
    kinds = texts.select("key", "word").distinct()
    if stop is not None:
        kinds = kinds.join(stop.select("word").distinct(), "word", "left_anti")
    of = materialize(kinds.groupBy("key").agg(F.sort_array(F.collect_list("word")).alias("_key")))
    sets = materialize(of.select("_key").distinct().withColumn("set", F.monotonically_increasing_id()))
    numbered = materialize(join_spread(of, sets, "_key").select("key", "set"))
    side = lambda s: numbered.select(F.col("key").alias(s), F.col("set").alias(f"_set_{s}"))
    both = F.struct(*(F.coalesce(f"_set_{s}", F.lit(-1).cast("long")).alias(s) for s in "ab")).alias("_key")  # a text without words is in no set
    own = materialize(pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(*(c for c in pairs.columns if c not in ("a", "b")), both))
    words = materialize(sets.select(F.col("set").alias("key"), F.explode("_key").alias("word")))
    asked = materialize(own.select("_key.a", "_key.b").distinct())
    found = products(asked, materialize(context_vectors(words, vectors)))
    lists = materialize(words.join(vectors.select("word").distinct(), "word", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list("word")).alias("words")))
    for s in "ab":
        found = found.join(lists.select(F.col("key").alias(s), F.col("words").alias(f"words_{s}")), s, "left")
    made = materialize(found.select(F.struct("a", "b").alias("_key"), "dot", "na", "nb", "words_a", "words_b"))
    return join_spread(own, made, "_key").drop("_key")


def cosine(pairs: DataFrame, context: DataFrame) -> DataFrame:
    """pairs (a, b, ..) with score: cosine of the vectors of keys a and b, 0 without one."""
    return products(pairs, context).select(*pairs.columns, F.coalesce(F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.col("na") * F.col("nb"))), F.lit(0.0)).alias("score"))
