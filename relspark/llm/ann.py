"""Approximate nearest neighbours by cosine, with cross-polytope hashing.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a fast
Hadamard transform) and assigned to the nearest of the signed axes. Each table has its
own rotations; a bucket is the axes of several of them, of more the more vectors there are.

A query's nearness to a bucket is the sum of its nearness to the bucket's axes. In each
table it probes the nearest buckets, down to a bound below which there is a given share of
a sample of the vectors, and all vectors found are ranked by their exact cosine. The share
is the smallest that finds enough true neighbours of a sample of the queries: small for
vectors with structure, large for vectors spread evenly, and all of a small table.

Copies of a vector are one entry of the index, with as many of its smallest ids as a
result can hold. Buckets that share their first axes are a group, which a query visits only
if one of them may be near enough. Groups are cut into blocks of bounded size, so a crowded
group is many tasks' work, and none holds more than a block of vectors and a block of queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from relspark.llm.common import materialize

TABLES, BLOCK = 2, 4_096
#: Sizes of the samples of vectors and of queries, the recall to reach for the latter, and the fewest
#: vectors that a query looks at in a table (all, if there are no more).
SAMPLE, SAMPLE_QUERIES, RECALL, LEAST = 4_096, 100, 0.96, 4_096
#: Components that a ranking multiplies at once, and the slack of its products.
PART, SLACK = 1 << 22, 1e-6


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, n))
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return out


def axes(x: np.ndarray, table: int, hashes: int) -> list[np.ndarray]:
    """For each hash of a table, every row's nearness to the signed axes: +0, -0, +1, -1, .."""
    out = []
    for h in range(hashes):
        y = rotate(x, table * 1_000 + h)
        out.append(np.stack([y, -y], 2).reshape(len(y), -1))
    return out


def hashes_for(n: int, n_axes: int) -> int:
    """As many that there are more buckets than vectors."""
    return 1 + max(1, round(math.log(max(n, 2)) / math.log(n_axes)))


def codes(x: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """n x hashes: the axes of each row's bucket."""
    return np.stack([near.argmax(1) for near in axes(x, table, hashes)], 1).astype(np.int16)


def bucket_scores(near: list[np.ndarray], code: np.ndarray) -> np.ndarray:
    """Queries x buckets: sums of the queries' nearness to the buckets' axes."""
    total = near[0][:, code[:, 0]].copy()
    for h in range(1, len(near)):
        total += near[h][:, code[:, h]]
    return total


class Grouping(NamedTuple):
    """Groups of buckets: those with the same first `depth` axes and one part of the next."""

    n_axes: int
    depth: int
    parts: int

    def of(self, code: np.ndarray) -> np.ndarray:
        group = np.zeros(len(code), np.int64)
        for h in range(self.depth):
            group = group * self.n_axes + code[:, h]
        return group * self.parts + (code[:, self.depth].astype(np.int64) * self.parts // self.n_axes if self.parts > 1 else 0)

    def near(self, near: list[np.ndarray], bound: float) -> np.ndarray:
        """Groups of one query with a bucket that reaches the bound. near: its nearness to the axes of each hash."""
        rest = [sum(x.max() for x in near[h + 1 :]) for h in range(len(near))]
        group, total = np.zeros(1, np.int64), np.zeros(1)
        for h in range(self.depth):
            both = total[:, None] + near[h][None, :]
            i, axis = np.nonzero(both + rest[h] >= bound - SLACK)
            group, total = group[i] * self.n_axes + axis, both[i, axis]
        if self.parts == 1:
            return group[total + (rest[self.depth - 1] if self.depth else np.inf) >= bound - SLACK]
        part = np.arange(self.n_axes) * self.parts // self.n_axes
        top = np.full(self.parts, -np.inf)
        np.maximum.at(top, part, near[self.depth])
        i, p = np.nonzero(total[:, None] + top[None, :] + rest[self.depth] >= bound - SLACK)
        return group[i] * self.parts + p


def grouping(n: int, n_axes: int, hashes: int, block: int) -> Grouping:
    """About a group for each block."""
    many, depth = max(1, n // block), 0
    while many > n_axes and depth < hashes - 1:
        many, depth = many // n_axes, depth + 1
    return Grouping(n_axes, depth, max(1, min(many, n_axes)))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def unpack(vectors: pa.Array, kind: str = "<f8") -> np.ndarray:
    """Rows of doubles from a binary column of components of that kind."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.zeros((0, 1))
    ends = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1]
    return np.frombuffer(vectors.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(vectors), -1).astype(float)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in one order of summation whatever the other rows are."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & fine & F.exists(x, lambda v: v != 0)


def entries(rows: DataFrame, keep: int, kind: str) -> DataFrame:
    """(a, b, vector, ids, entry): each distinct vector, with a fingerprint of 128 bits by which it is
    known, and its `keep` smallest ids, which is as many as any result can hold. Tasks merge copies batch
    by batch before anything is shuffled."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, set] = {}
            for vec_id, vector in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1), kind)):
                held.setdefault(vector, set()).add(vec_id)
            yield pa.RecordBatch.from_pydict({"vector": pa.array(list(held), pa.binary()), "ids": pa.array([sorted(s)[:keep] for s in held.values()], pa.list_(pa.int64()))})

    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    return fingerprinted(rows.mapInArrow(merge, "vector binary, ids array<long>")).groupBy("a", "b").agg(F.first("vector").alias("vector"), smallest).withColumn("entry", F.col("ids")[0])


def fingerprinted(df: DataFrame) -> DataFrame:
    return df.withColumn("a", F.xxhash64("vector")).withColumn("b", F.xxhash64(F.lit("vector"), "vector"))


def as_bytes(values: pa.ListArray, kind: str) -> list[bytes]:
    flat = np.ascontiguousarray(values.flatten().to_numpy(zero_copy_only=False), kind) + np.array(0, kind)  # no negative zero
    ends = np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    return [flat[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]


class Probing(NamedTuple):
    """What a task needs to know to probe."""

    tables: int
    hashes: int
    groups: Grouping
    sample: list[np.ndarray]  # for each table the codes of a sample of the vectors
    share: float  # of the vectors to be looked at in each table

    def bounds(self, near: list[np.ndarray], table: int) -> np.ndarray:
        """For each query the nearness down to which its buckets are probed."""
        known = self.sample[table]
        want = int(math.ceil(self.share * len(known)))
        if want >= len(known):
            return np.full(len(near[0]), -np.inf)
        score = bucket_scores(near, known)
        return np.partition(score, len(known) - want, axis=1)[:, len(known) - want]


def true_neighbours(known: DataFrame, asked: list[tuple[int, bytes]], k: int, tables: int, hashes: int, kind: str) -> list[tuple[int, list[float]]]:
    """(query, nearness of the bucket in each table) for the k nearest other vectors of each of a few
    queries (entry, vector), by brute force: one pass over all vectors."""
    own = np.array([e for e, _ in asked])
    q = units(np.vstack([np.frombuffer(v, kind).astype(float) for _, v in asked]))
    near = [axes(q, t, hashes) for t in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(unpack(batch.column("vector"), kind))
            product = q @ x.T
            product[own[:, None] == batch.column("entry").to_numpy()[None, :]] = -2.0
            best = np.argsort(-product, 1)[:, :k]
            some, at = np.unique(best), best.ravel()
            of = [codes(x[some], t, hashes) for t in range(tables)]
            place, row = np.searchsorted(some, at), np.repeat(np.arange(len(q)), best.shape[1])
            scores = np.stack([sum(near[t][h][row, of[t][place, h]] for h in range(hashes)) for t in range(tables)], 1)
            far = -product[row, at]
            keep = far < 2.0
            yield pa.RecordBatch.from_pydict({"q": pa.array(row[keep]), "far": pa.array(far[keep]), "scores": pa.array(scores[keep].tolist(), pa.list_(pa.float64()))})

    found = known.select("entry", "vector").mapInArrow(run, "q long, far double, scores array<double>")
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "scores"))), 1, k).alias("best"))
    return [(r["q"], b["scores"]) for r in best.collect() for b in r["best"]]


def probing(known: DataFrame, queries: DataFrame, n: int, k: int, tables: int, hashes: int | None, probes: int | None, block: int, kind: str, recall: float) -> Probing:
    """Parameters by the number of vectors, and the share by the recall on a sample of the queries (unless
    a number of probes is given). The samples are a few thousand rows, whatever the tables' sizes."""
    some = known.where(F.pmod(F.xxhash64(F.lit("sample"), "entry"), F.lit(n)) < SAMPLE).select("vector").collect()
    n_axes = 2 * (1 << max(0, int(len(some[0]["vector"]) // np.dtype(kind).itemsize - 1).bit_length())) if some else 2
    hashes = hashes or hashes_for(n, n_axes)
    x = units(np.vstack([np.frombuffer(r["vector"], kind).astype(float) for r in some])) if some else np.zeros((0, 1))
    made = Probing(tables, hashes, grouping(n, n_axes, hashes, block), [codes(x, t, hashes) if len(x) else np.zeros((0, hashes), np.int16) for t in range(tables)], 1.0)
    if probes is not None:
        return made._replace(share=min(1.0, probes / n_axes**hashes))
    if n <= LEAST or not some:
        return made
    n_queries = queries.count()
    asked = [(r["entry"], bytes(r["vector"])) for r in queries.where(F.pmod(F.xxhash64(F.lit("sample"), "entry"), F.lit(max(1, n_queries))) < SAMPLE_QUERIES).select("entry", "vector").collect()]
    if not asked:
        return made
    truth = true_neighbours(known, asked, k, tables, hashes, kind)
    near = [axes(units(np.vstack([np.frombuffer(v, kind).astype(float) for _, v in asked])), t, hashes) for t in range(tables)]
    row, scores = np.array([q for q, _ in truth]), np.array([s for _, s in truth])
    share = LEAST / n
    while share < 1.0:
        bound = np.stack([made._replace(share=share).bounds(near[t], t) for t in range(tables)], 1)
        if (scores >= bound[row] - SLACK).any(1).mean() >= recall:
            break
        share *= 1.2
    return made._replace(share=min(1.0, share))


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, hashes: int | None = None, probes: int | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, recall: float = RECALL,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row for which is_query holds, the k
    nearest other rows found, nearest first, ties to the smaller id.

    Rows take no part whose id is null, or whose vector is null, empty, zero, or holds a null
    or non-finite component, or has another length than most. Rows that repeat an id and its
    vector count once; a row is never found for a query of its own id. Fewer than k rows are
    returned only if there are fewer other rows: a query that found fewer looks at all. Other
    columns are not read. An empty table: no rows.

    hashes and probes (buckets of a table that a query probes, as a share of all) are chosen by
    the data unless given: see `probing`.
    """
    fine = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    lengths = fine.groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n_dims = lengths[0]["n"] if lengths else 1
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    fine = fine.where(F.size(vector_col) == n_dims)
    rows = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("v"))
    known = materialize(entries(rows(fine), k + 1, kind))
    n = known.count()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_bytes(batch.column(1), kind), pa.binary())], ["query_id", "vector"])

    asked = fingerprinted(rows(fine.where(is_query)).mapInArrow(packed, "query_id long, vector binary")).select("query_id", "a", "b").distinct()
    asked = materialize(asked.join(known.select("a", "b", "entry"), ["a", "b"]).select("query_id", "entry"))
    chosen = known.select("entry", "vector", "ids")
    queries = chosen.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "vector")
    how = probing(known, queries, max(n, 1), k, tables, hashes, probes, block, kind, recall)
    keys = ["table", "group", "i", "j"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in the group of its bucket in each table."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_024):
                some = batch.slice(lo, 1_024)
                x = units(unpack(some.column("vector"), kind))
                for t in range(how.tables):
                    group = how.groups.of(codes(x, t, how.hashes))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(group), *(some.column(c) for c in ("entry", "vector", "ids"))], ["table", "group", "entry", "vector", "ids"])

    def visits(how: Probing):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each query in the groups that it visits, with the bound of its buckets."""
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    some = batch.slice(lo, 256)
                    x = units(unpack(some.column("vector"), kind))
                    for t in range(how.tables):
                        near = axes(x, t, how.hashes)
                        bound = how.bounds(near, t)
                        groups = [how.groups.near([y[i] for y in near], bound[i]) for i in range(len(x))]
                        at = np.repeat(np.arange(len(x)), [len(g) for g in groups])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), t, np.int32)), pa.array(np.concatenate(groups)), *(some.column(c).take(pa.array(at)) for c in ("entry", "vector")), pa.array(bound[at])],
                            ["table", "group", "entry", "vector", "bound"],
                        )

        return run

    def rank(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """The k + 1 best of a block's vectors in probed buckets, for each query of a block."""
        found: list = []
        if mine.num_rows and theirs.num_rows:
            x, q = unpack(mine.column("vector"), kind), unpack(theirs.column("vector"), kind)
            unit, t = units(x), mine.column("table")[0].as_py()
            code, bound = codes(unit, t, how.hashes), theirs.column("bound").to_numpy()
            ids = mine.column("ids").to_pylist()
            take = min(len(x), k + 1)
            for lo in range(0, len(q), 256):
                part = q[lo : lo + 256]
                product = units(part) @ unit.T
                probed = bucket_scores(axes(units(part), t, how.hashes), code) >= bound[lo : lo + 256, None] - SLACK
                product[~probed] = -3.0
                # All that the product, which rounds otherwise, does not tell from the last of the best.
                last = np.partition(product, len(x) - take, axis=1)[:, len(x) - take]
                at, near = np.nonzero((product >= last[:, None] - SLACK) & probed)
                step = max(1, PART // x.shape[1])
                score = np.concatenate([np.zeros(0), *(cosines(part[at[i : i + step]], x[near[i : i + step]]) for i in range(0, len(at), step))])
                ends = np.searchsorted(at, np.arange(len(part) + 1))
                for of, s in ((near[i:j], score[i:j]) for i, j in zip(ends[:-1], ends[1:])):
                    best = heapq.nsmallest(k + 1, ((-v, i) for v, e in zip(s.tolist(), of.tolist()) for i in ids[e]))
                    found.append([{"far": v, "id": i} for v, i in best])
        queries = theirs.column("entry") if found else pa.array([], pa.int64())
        return pa.table({"entry": queries, "found": pa.array(found, pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())])))})

    index = chosen.mapInArrow(spread, "table int, group long, entry long, vector binary, ids array<long>")

    def meet(some: DataFrame, how: Probing) -> DataFrame:
        """entry, found: for each of some queries its k + 1 best."""
        probe = some.mapInArrow(visits(how), "table int, group long, entry long, vector binary, bound double")
        # Blocks of each group: as many as its size asks for. At most tables x groups rows.
        sizes = index.groupBy("table", "group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        asks = probe.groupBy("table", "group").agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks"))
        plan = sizes.join(asks, ["table", "group"])

        def dealt(df: DataFrame, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
            """Each row goes to one block of its kind, and there to every block of the other kind."""
            return (
                df.join(plan, ["table", "group"])
                .withColumn(own_block, F.pmod(F.xxhash64("entry"), F.col(own)).cast("int"))
                .withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .drop("blocks", "q_blocks")
            )

        left = dealt(index, "blocks", "q_blocks", "i", "j")
        right = dealt(probe, "q_blocks", "blocks", "j", "i")
        ranked = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "entry long, found array<struct<far:double,id:long>>")
        return ranked.groupBy("entry").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k + 1).alias("found"))

    best = materialize(meet(queries, how))
    short = queries.join(best.where(F.size("found") > k).select("entry"), "entry", "left_anti")
    if how.share < 1.0 and not short.isEmpty():
        best = best.where(F.size("found") > k).unionByName(meet(short, how._replace(share=1.0)))
    mine = asked.join(best, "entry").select("query_id", F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k).alias("found"))
    return mine.select("query_id", F.posexplode("found").alias("at", "f")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.far")).alias("score")
    )
