"""Clustering by Lloyd's rounds on integers.

Every round sends the centroids to all tasks. A task takes its vectors a batch at a time,
finds squared differences to each centroid in numpy, takes the nearest (the lowest number
among equals) and adds its vectors up by cluster, so it hands on one sum for each cluster
and component, whatever the number of its vectors. Integers make the sums, and so all
results, the same in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from relspark.llm.common import materialize

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Magnitude up to which squared distances of 64 components surely fit 64 bits; beyond it numpy counts in Python's integers.
PLAIN = 1 << 27
ROWS = 4096  # of a numpy pass


def as_integers(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of the components of vectors with exactly `size` of them, none null, not finite
    or beyond 64 bits then. Others take no part."""
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = lambda x: x.isNotNull() & (F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(2.0**63))  # noqa: E731  (false for NaN, which is the largest double)
    fine = (F.size(vector_col) == size) & F.forall(vector_col, fits)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), scaled.cast("array<long>").alias("v"))


def start_key(id_: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256)


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids; repeated ids in the order of their vectors. Rows without an id cannot be one."""
    return [r["v"] for r in kept.where(F.col("id").isNotNull()).orderBy(start_key(F.col("id"), seed), "v").limit(clusters).select("v").collect()]


def as_matrix(rows: list, size: int) -> np.ndarray:
    """Integers as an array of 64 bits if all squares surely fit, else of Python's own."""
    m = np.array(rows, np.int64).reshape(len(rows), size)
    return m.astype(object) if m.size and (m.max() > PLAIN or m.min() < -PLAIN) else m


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid, the lowest of equals, and its squared distance."""
    if v.dtype == object or centroids.dtype == object:
        v, centroids = v.astype(object), centroids.astype(object)
    d = np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(v)), best]


def batches_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lo in range(0, len(frame), ROWS):
            yield frame.iloc[lo : lo + ROWS]


def cluster_sums(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, total, n): sums of the vectors nearest to each centroid."""
    held, size = kept.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        totals, n = np.zeros((len(c), size), object), np.zeros(len(c), np.int64)
        for frame in batches_of(frames):
            v = as_matrix(frame["v"].tolist(), size)
            best, _ = nearest(v, c)
            for k in np.unique(best):
                totals[k] += v[best == k].sum(0).astype(object)
            n += np.bincount(best, minlength=len(c))
        some = np.flatnonzero(n)
        from decimal import Decimal

        yield pd.DataFrame({
            "cluster": np.repeat(some, size).astype("int32"), "dim": np.tile(np.arange(size, dtype="int32"), len(some)),
            "total": [Decimal(int(x)) for x in totals[some].ravel()], "n": np.repeat(n[some], size),
        })

    return kept.select("v").mapInPandas(add, "cluster int, dim int, total decimal(38,0), n long").groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(kept: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> np.ndarray:
    """The centroids after all rounds. Only clusters x components sums reach the driver in each."""
    centroids = first_centroids(kept, clusters, seed)
    for _ in range(rounds if centroids else 0):
        for r in cluster_sums(kept, as_matrix(centroids, size)).collect():
            centroids[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]  # the floor, for negative sums too
    return as_matrix(centroids, size)


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row for each vector that takes part: id_col, cluster, distance (squared, to its centroid), cluster_inertia and inertia
    (its sum over the cluster, and over all), centroid_sha256 (of the centroid's components in decimal, joined by commas).

    Centroids start as the vectors of the smallest hashes of `seed:id`, fewer than `clusters` if there are fewer vectors. Ties of distance go to the
    lower number; a cluster left empty keeps its centroid. Null and repeated ids are kept, a row each; a null id starts no
    centroid. Without any vector that has an id, and for an empty table, there are no rows. Distances and sums beyond 64 bits are null. Other columns are not read.
    """
    spark = vectors.sparkSession
    kept = materialize(as_integers(vectors, size, scale, id_col, vector_col))
    centroids = fit(kept, clusters, rounds, seed, size)
    held = spark.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches_of(frames):
            if not len(held.value):
                return
            best, distance = nearest(as_matrix(frame["v"].tolist(), size), held.value)
            fits = pd.array([int(d) if d < 1 << 63 else None for d in distance.tolist()], "Int64")
            yield pd.DataFrame({"id": frame["id"].to_numpy(), "cluster": best.astype("int32"), "distance": fits})

    schema = T.StructType([kept.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = materialize(kept.mapInPandas(assign, schema))
    by_cluster = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    per = {r["cluster"]: r["cluster_inertia"] for r in by_cluster.collect()}  # a row for each cluster
    inertia = None if None in per.values() or sum(per.values()) >= 1 << 63 else sum(per.values())
    rows = [(k, per[k], inertia, hashlib.sha256(",".join(str(int(x)) for x in centroids[k]).encode()).hexdigest()) for k in per]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> str:
    """DuckDB SQL for `cluster` over embeddings."""
    square = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT x.r, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v, min([{square}, c.k]) AS best FROM kept x, c{t} c GROUP BY x.r)")
        if t < rounds:
            steps.append(
                f"s{t} AS (SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT best[2] AS k, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{t}) GROUP BY k, i), "
                f"m{t} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{t} GROUP BY k), "
                f"c{t + 1} AS MATERIALIZED (SELECT k, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN m{t} m USING (k))"
            )
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS k, v FROM kept WHERE vec_id IS NOT NULL ORDER BY k LIMIT {clusters}),
{", ".join(steps)}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.k = a.best[2]"""
