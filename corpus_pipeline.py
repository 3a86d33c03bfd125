"""The corpus pipeline over documents. Each stage's result is written and read again as the
next one's docs; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relspark.lexicon import release_since, written
from relspark.llm import decontam, line_dedup, ngram_join, quality, queries
from relspark.llm.common import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many documents of their source go, and documents of which nothing is left."""
    cut = line_dedup.drop_boilerplate(docs, host="source")
    left = cut.where((F.col("n_dropped") == 0) | (F.trim(F.col("text")) != ""))
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return left.select(*columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", drop_boilerplate_lines),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the tokenizer and the components of a join are beyond SQL: tests/llm has a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        release_since(spark, mark, but=(docs,))  # the stage's own tables, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
