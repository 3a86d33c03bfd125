"""Joins and running totals that no hot key and no global order bring into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relspark.lexicon import materialize

#: A key of at least one in so many rows is hot; there are at most so many of them.
HOT = 1000


def hot_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key): those of at least one in HOT of the n rows, so HOT rows at most."""
    return rows.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") * HOT >= n) & F.col(key).isNotNull()).select(key)


def join_spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left join with a table of one row for each key, in which no hot key is one task's: hot keys meet it by broadcast, all
    others by shuffle. Rows without a key, and those that have met, are dealt out evenly."""
    known = right.join(F.broadcast(hot_keys(left, key, left.count())), key, "left_semi")
    values = [c for c in right.columns if c != key]
    first = left.join(F.broadcast(known.select(key, F.struct(*values).alias("_spread_hot"))), key, "left")
    done = F.col("_spread_hot").isNotNull() | F.col(key).isNull()
    salted = first.withColumn("_spread_key", F.when(~done, F.col(key))).withColumn("_spread_salt", F.when(done, F.pmod(F.monotonically_increasing_id(), F.lit(8192))).otherwise(F.lit(0).cast("long")))
    rest = right.select(F.col(key).alias("_spread_key"), F.struct(*values).alias("_spread_cold"), F.lit(0).cast("long").alias("_spread_salt"))
    # A table whose files are small by compression would be sent to the driver whole; only hot keys are.
    met = salted.join(rest.hint("merge"), ["_spread_key", "_spread_salt"], "left").withColumn("_spread_met", F.coalesce("_spread_hot", "_spread_cold"))
    return met.select(*left.columns, *(F.col(f"_spread_met.{c}").alias(c) for c in values))


def running_total(rows: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """rows with the sum of value over all rows before, in the order given (equal rows are in one task, in any order).

    Rows are dealt by ranges of the order; each range adds up its own, and starts from the sum of the ranges before it,
    of which there is one row each."""
    ranged = materialize(rows.withColumn(name, value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    starts = ranged.groupBy("_range").agg(F.sum(name).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum(name).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(name, own).join(F.broadcast(starts.select("_range", "_start")), "_range").select(*rows.columns, (F.col(name) + F.col("_start")).cast("long").alias(name))
