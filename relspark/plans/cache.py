"""Scores kept from one run to the next, as a table in a shared folder.

Scores hold for one lexicon, one measure and one set of options, so each of these has a folder of
its own, named by their hash. A run scores the pairs that no earlier run has, and adds them as files of
its own; nothing is rewritten. Where the table is bounded, the oldest runs go when it is opened next.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from relspark.lexicon import Lexicon, delete_folder, materialize
from relspark.operators.joins import join_spread


@dataclass(frozen=True)
class ScoreCache:
    """folder: shared by the driver and all executors. max_pairs: for each lexicon, measure and options; None: no bound. Whole
    runs go, the oldest first, until no more pairs are left; a run that alone has more is not kept."""

    folder: str
    max_pairs: int | None = None


def fingerprint(df: DataFrame | None) -> str:
    """Of the rows, in any order. Sums of two hashes, so that few rows reach the driver: one."""
    if df is None:
        return "none"
    columns = sorted(df.columns)
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), total(1).alias("x"), total(2).alias("y")).first()
    return f"{','.join(columns)}:{r['n']}:{r['x']}:{r['y']}"


def key_of(lexicon: Lexicon, name: str, config) -> str:
    """The folder's name: of all that a score depends on but the pair."""
    parts = [name, *(fingerprint(t) for t in (lexicon.synset, lexicon.sense, lexicon.edge, lexicon.taxonomy))]
    for f in fields(config):
        value = getattr(config, f.name)
        parts.append(f"{f.name}={fingerprint(value) if isinstance(value, DataFrame) else value!r}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def runs_of(spark: SparkSession, folder: str) -> list[str]:
    """Finished runs, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path)]
    return sorted(p.toString() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def evict(spark: SparkSession, folder: str, max_pairs: int) -> None:
    runs = runs_of(spark, folder)
    sizes = [spark.read.parquet(r).count() for r in runs]
    while sum(sizes) > max_pairs:
        delete_folder(spark, runs.pop(0))
        sizes.pop(0)


#: Equal rows that are made again from one.
PART = 1 << 10


def scored(cache: ScoreCache, key: str, pairs: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs with score, err_level and err_msg, of which only pairs that are not stored are scored, and stored. keys: the columns that
    name a pair; nulls are values like others. The result reads the table's files when it is used.

    Equal pairs are counted first, so that a pair is one row. It meets the table once; what it does not find there is written by its own run
    with its number, so that the run's scores meet no pairs again."""
    spark, folder = pairs.sparkSession, f"{cache.folder.rstrip('/')}/{key}"
    if cache.max_pairs is not None:
        evict(spark, folder, cache.max_pairs)
    name = F.struct(*keys).alias("_pair")  # equal also where both have nulls
    values = ["score", "err_level", "err_msg"]
    counted = pairs.select(name).groupBy("_pair").agg(F.count("*").alias("_n"))  # dealt by the key that the join goes by
    asked = counted.select("_pair.*", "_n")
    stored = T.StructType([T.StructField("_pair", pairs.select(name).schema["_pair"].dataType), *T._parse_datatype_string("score double, err_level int, err_msg string").fields])
    found = None
    if runs := runs_of(spark, folder):
        kept = spark.read.schema(stored).parquet(*runs).groupBy("_pair").agg(F.first(F.struct(*values)).alias("_s"))  # two runs side by side may both have one
        met = materialize(counted.join(kept, "_pair", "left").select("_pair.*", "_n", "_s"))
        found, asked = met.where("_s is not null").select(*keys, "_n", "_s.*"), met.where("_s is null").select(*keys, "_n")
    else:
        asked = materialize(asked)
    if not asked.isEmpty():
        fresh = f"{folder}/run-{time.time_ns():020d}-{uuid.uuid4().hex}"
        score(asked).select(name, F.col("score").cast("double").alias("score"), F.col("err_level").cast("int").alias("err_level"), "err_msg", "_n").write.parquet(fresh)
        made = spark.read.schema(T.StructType([*stored.fields, T.StructField("_n", T.LongType())])).parquet(fresh).select("_pair.*", "_n", *values)
        found = made if found is None else found.unionByName(made)
    if found is None:  # no pairs at all
        return score(pairs).select(*pairs.columns, *values)
    if set(pairs.columns) == set(keys):
        # A pair's rows are made again in parts, so that no array grows with their number.
        parts = found.select("*", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / PART).cast("int"))).alias("_k"))
        size = F.least(F.lit(PART), F.col("_n") - F.col("_k") * PART).cast("int")
        return parts.select(*pairs.columns, *values, F.explode(F.array_repeat(F.lit(0), size)).alias("_i")).drop("_i")
    return join_spread(pairs.withColumn("_pair", name), found.select(name, *values), "_pair").select(*pairs.columns, *values)
