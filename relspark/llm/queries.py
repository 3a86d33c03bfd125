"""The queries opN_* over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relspark.llm import alignment, ann, chat, clustering, decontam, licenses, line_dedup, ngram_join, packing, quality, secrets, token_counts, url_filter
from relspark.llm.common import table

MAX_TOKENS = 1024
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, field).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(
        F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(t).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for t, role in enumerate(("user", "assistant"))))).alias("r")
    ).select("r.*")
    return chat.digests(chat.format_conversations(rows.unionByName(added)))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    byte_level = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return alignment.summarize(table(spark, sf_dir, "documents"), byte_level, tokenizer_path("piece_bpe_32k.model"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.outcomes_of(pages, table(spark, sf_dir, "labels")), URL_RULES)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_license_scan": op5_license_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_url_filter": op13_url_filter,
}
ORACLE_SQL: dict[str, str] = {"op10_line_dedup": line_dedup.oracle(), "op12_centroid_clustering": clustering.oracle(), "op13_url_filter": url_filter.oracle(URL_RULES)}
