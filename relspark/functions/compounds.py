"""Compounds: the longest known sequence of words, from left to right.

Two ways: an Arrow function for any texts with a dictionary whose size is bounded (it is
broadcast by its checked size), and a join for dictionaries beyond that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from relspark.operators.joins import join_spread

MAX_WORDS = 9
TOKEN = re.compile(r"[a-zA-Z0-9_.\-/']+")


def greedy(words: list[str], known: set[str], max_words: int = MAX_WORDS) -> list[str]:
    out, i = [], 0
    while i < len(words):
        for j in range(min(len(words), i + max_words), i + 1, -1):
            joined = "_".join(words[i:j])
            if joined in known:
                out.append(joined)
                i = j
                break
        else:
            out.append(words[i])
            i += 1
    return out


def compoundify(df: DataFrame, text: str, compounds: DataFrame, out: str = "compounds", max_bytes: int = 64 << 20) -> DataFrame:
    """df with a column of texts whose compounds are joined by underscores. compounds: word. A null text stays null.

    A dictionary of at most max_bytes is looked up in the tasks; with a larger one the distinct texts go through `compound_tokens`."""
    size = compounds.agg(F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0)).alias("n")).first()["n"]
    if size > max_bytes:
        docs = df.select(F.col(text).alias("_key")).where("_key is not null").distinct().withColumn("_ws", F.regexp_extract_all("_key", F.lit(TOKEN.pattern), F.lit(0)))
        tokens = compound_tokens(docs, compounds, "_key", "_ws").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("_t"))
        made = tokens.select("_key", F.array_join(F.transform("_t", lambda t: t["token"]), " ").alias("_made"))
        joined = join_spread(df.withColumn("_key", F.col(text)), made, "_key")
        return joined.withColumn(out, F.when(F.col("_key").isNotNull(), F.coalesce("_made", F.lit("")))).drop("_key", "_made")
    known = df.sparkSession.sparkContext.broadcast({r["word"] for r in compounds.toLocalIterator()})

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: None if t is None else " ".join(greedy(TOKEN.findall(t), known.value)))

    return df.withColumn(out, run(F.col(text)))


def compound_tokens(docs: DataFrame, compounds: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, at, token) with compounds of a dictionary of any size. tokens: array of words.

    Every sequence of words is looked up by a join; the matches of a text then meet its words,
    and a fold over them keeps those that the greedy walk reaches."""
    known = compounds.select(F.col("word").alias("joined")).distinct().withColumn("n", F.size(F.split("joined", "_")).cast("int")).where(f"n between 2 and {MAX_WORDS}")
    base = docs.select(key, F.col(tokens).alias("ws"))
    starts = base.select(key, "ws", F.posexplode("ws").alias("at", "w"))
    spans = starts.where(F.size("ws") - F.col("at") >= 2).select(key, "at", F.explode(F.transform(F.sequence(F.lit(2), F.least(F.lit(MAX_WORDS), F.size("ws") - F.col("at"))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("ws", F.col("at") + 1, n), "_").alias("joined")))).alias("s"))
    # A sequence has one number of words. Its key is spread, as few compounds may be most matches; nothing but hot ones is sent to all tasks.
    met = join_spread(spans.select(key, "at", "s.n", "s.joined"), known.select("joined", F.col("n").alias("_n")), "joined").where("n = _n")
    found = met.groupBy(key, "at").agg(F.max("n").alias("n"))
    longest = found.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("at", "n")))).alias("longest"))
    held = base.join(longest.hint("merge"), key, "left")  # as many rows as documents, however small their files
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,n:int>>").alias("out"))

    def step(acc, at):
        n = F.coalesce(F.try_element_at(F.col("longest"), at), F.lit(1))
        taken = F.struct((at + n).alias("next"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), n.alias("n")))).alias("out"))
        return F.when(at < acc["next"], acc).otherwise(taken)

    folded = F.when(F.size("ws") > 0, F.aggregate(F.sequence(F.lit(0), F.size("ws") - 1), start, step, lambda a: a["out"]))
    return held.select(key, "ws", F.explode(folded).alias("c")).select(key, F.col("c.at").alias("at"), F.array_join(F.slice("ws", F.col("c.at") + 1, F.col("c.n")), "_").alias("token"))
