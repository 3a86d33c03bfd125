"""Base forms of words, as a table (form, pos, lemma) built from exception lists and suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: The public suffix rules of English base forms.
RULES = [
    ("n", "s", ""), ("n", "ses", "s"), ("n", "xes", "x"), ("n", "zes", "z"), ("n", "ches", "ch"), ("n", "shes", "sh"), ("n", "men", "man"), ("n", "ies", "y"),
    ("v", "s", ""), ("v", "ies", "y"), ("v", "es", "e"), ("v", "es", ""), ("v", "ed", "e"), ("v", "ed", ""), ("v", "ing", "e"), ("v", "ing", ""),
    ("a", "er", ""), ("a", "est", ""), ("a", "er", "e"), ("a", "est", "e"),
]


def morph_table(forms: DataFrame, sense: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(form, pos, lemma) for each of forms (word): itself where it is a word of the lexicon, what the
    exception list (form, pos, lemma) says, or, where that has nothing, what a suffix rule makes of
    it, if the lexicon has that word in that part of speech."""
    known = sense.select(F.col("word").alias("lemma"), "pos").distinct()
    asked = forms.select(F.lower("word").alias("form")).distinct()
    own = asked.withColumn("lemma", F.col("form")).join(known, "lemma").select("form", "pos", "lemma")
    rules = F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, a, b in RULES))
    made = asked.select("form", F.explode(F.filter(rules, lambda r: F.endswith(F.col("form"), r["a"]))).alias("r")).select(
        "form", F.col("r.pos").alias("pos"), F.concat(F.expr("substring(form, 1, length(form) - length(r.a))"), F.col("r.b")).alias("lemma")
    )
    if exceptions is not None:
        listed = asked.join(exceptions, "form").select("form", "pos", "lemma")
        made = made.join(listed.select("form", "pos"), ["form", "pos"], "left_anti").unionByName(listed)
    return own.unionByName(made.where("lemma <> ''").join(known, ["lemma", "pos"]).select("form", "pos", "lemma")).distinct()


def stems(words: DataFrame, morph: DataFrame) -> DataFrame:
    """(word, stems): all base forms of each word over all parts of speech, sorted; none if unknown."""
    found = morph.groupBy("form").agg(F.sort_array(F.collect_set("lemma")).alias("stems"))
    asked = words.select("word").distinct()
    return asked.join(found, F.lower(asked["word"]) == found["form"], "left").select("word", F.coalesce("stems", F.array().cast("array<string>")).alias("stems"))


def stem_text(df: DataFrame, key: str, text: str, morph: DataFrame, pattern: str = r"(\w+)") -> DataFrame:
    """(key, stemmed): words (pattern) of the text replaced where they have exactly one base form."""
    spread = df.select(F.col(key), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("at", "word"))
    known = stems(spread, morph)
    one = F.when(F.size("stems") == 1, F.col("stems")[0]).otherwise(F.col("word"))
    joined = spread.join(known, "word", "left").select(key, F.struct("at", one.alias("w")).alias("t"))
    return joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["w"]), " ").alias("stemmed"))


def vector_stem(words: DataFrame, morph: DataFrame) -> DataFrame:
    """(word, stem): of several base forms only those of nouns count; used if exactly one is left."""
    every = morph.groupBy("form").agg(F.collect_set("lemma").alias("all"), F.collect_set(F.when(F.col("pos") == "n", F.col("lemma"))).alias("nouns"))
    asked = words.select("word").distinct()
    left = F.when(F.size("all") > 1, F.col("nouns")).otherwise(F.col("all"))
    return asked.join(every, asked["word"] == every["form"], "left").select("word", F.when(F.size(left) == 1, left[0]).otherwise(F.col("word")).alias("stem"))
