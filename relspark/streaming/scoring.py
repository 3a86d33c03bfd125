"""Scoring of pairs that keep arriving: a stream joined with the standing lexicon, batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from relspark.lexicon import Lexicon
from relspark.operators import senses as sn
from relspark.plans import measures as ms
from relspark.sources import lists


def score_stream(
    pairs: DataFrame, lexicon: Lexicon, measure: str, sink: Callable[[DataFrame, int], None], checkpoint: str,
    config: ms.Config | None = None, morph: DataFrame | None = None, all_senses: bool = False, **trigger,
) -> StreamingQuery:
    """Scores streamed pairs (w1, w2) with `measure` and hands each batch's result to the sink with
    its number. All measures look at one pair at a time, so no state is kept between batches; a
    batch that is run again after a failure has the same number, by which a sink can drop it."""

    def each(batch: DataFrame, number: int) -> None:
        sink(ms.score_words(lexicon, batch, measure, config, morph, all_senses), number)

    return pairs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pair_lines(lines: DataFrame) -> DataFrame:
    """(w1, w2) of streamed lines (value) in the form of pair files."""
    return lists.word_pairs(lines).where("ok").select("w1", "w2")


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch in a folder of its own, which a second run of the batch overwrites."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")


#: Version that the service answers with.
VERSION = "relspark 0.1.0"


def answer(requests: DataFrame, lexicon: Lexicon, measures: tuple[str, ...], config: ms.Config | None = None, morph: DataFrame | None = None) -> DataFrame:
    """(request, reply) for requests (request, line): `v`, `s WORD`, `g WORD`, `r WORD1 WORD2 MEASURE`.
    A reply is a JSON text: the version, the senses of all base forms of a word, these with their
    definitions, or the best pair of senses. Lines of another form, words without a sense and
    measures beyond those named get an error. Each measure is one plan for all its requests."""
    f = F.split(F.trim("line"), r"\s+")
    asked = requests.select("request", f.alias("f"))
    command = F.get("f", F.lit(0))
    words = asked.where(command.isin("s", "g") & (F.size("f") == 2)).select("request", command.alias("c"), F.col("f")[1].alias("input"))
    forms = morph if morph is not None else lexicon.sense.select(F.col("word").alias("form"), "pos", F.col("word").alias("lemma")).distinct()
    found = words.join(sn.all_forms(words, lexicon.sense, forms), "input").join(lexicon.synset.select("pos", "id", "gloss"), ["pos", "id"])
    each = F.struct("wps", F.when(F.col("c") == "g", F.col("gloss")).alias("gloss"))
    replies = found.groupBy("request").agg(F.to_json(F.struct(F.array_sort(F.collect_set(each)).alias("senses"))).alias("reply"))
    replies = replies.unionByName(asked.where(command == "v").select("request", F.lit(json.dumps({"version": VERSION})).alias("reply")))
    both = asked.where((command == "r") & (F.size("f") == 4)).select("request", F.col("f")[1].alias("w1"), F.col("f")[2].alias("w2"), F.col("f")[3].alias("measure"))
    for name in measures:
        some = both.where(F.col("measure") == name)
        best = ms.score_words(lexicon, some.select("w1", "w2").distinct(), name, config, morph)
        replies = replies.unionByName(some.join(best, ["w1", "w2"]).select("request", F.to_json(F.struct("measure", "wps1", "wps2", "score")).alias("reply")))
    return requests.select("request").join(replies, "request", "left").select("request", F.coalesce("reply", F.lit(json.dumps({"error": "no answer"}))).alias("reply"))
