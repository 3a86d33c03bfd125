"""Packing of token pieces into sequences of fixed capacity.

Only the number of pieces of each length matters to the packing, and lengths are at
most the capacity. So the plan is made on the histogram of lengths, whose size does
not depend on the corpus: dominance reduction after Martello and Toth fixes small sets
of lengths that some best packing must contain, as often as the counts allow; the
shrunk instance goes to best-fit decreasing. The plan, a list of patterns with the
number of sequences that use each, is then dealt out to the pieces by their rank among
those of the same length, in parallel.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from relspark.llm.common import materialize

CAPACITY = 1024
#: Texts of characters below U+0240 only: their classes are the same in all Unicode versions.
BEYOND_LATIN = re.compile("[ɀ-\U0010ffff]")
_encoders: dict = {}


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file.

    ``ranks_path`` names the same vocabulary as ranks, for a library that is four times
    as fast; it takes the texts on which both surely agree, the tokenizer all others.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.plain, self.fast = Tokenizer.from_file(path), None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.plain.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={k: v for k, v in ranks.items() if v not in special.values()}, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and not BEYOND_LATIN.search(text):
            try:
                return self.fast.encode(text, allowed_special="all")
            except BaseException as e:  # its regular expressions give up on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.plain.encode(text, add_special_tokens=False).ids


def encoder(path: str, ranks_path: str | None, pattern: str | None) -> Encoder:
    key = (path, ranks_path)
    if key not in _encoders:
        _encoders[key] = Encoder(path, ranks_path, pattern)
    return _encoders[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full, but the first of a longer document may be shorter."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, min(capacity, e - s)) for s, e in zip(starts, starts[1:] + [n])]


# --- the plan ---------------------------------------------------------------


class Pattern(NamedTuple):
    sizes: tuple[int, ...]  # lengths in one sequence, in their order there
    times: int


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixes, for open lengths j from the largest down, sets F with j such that every
    feasible set with j is dominated by F: its other members can be dealt to members of F that are no smaller, so
    some best packing uses F. Lengths for which no such set is known stay for the remainder,
    and stay open to the sets of smaller ones.

    * j alone: nothing fits beside it.
    * {j, k}, k the largest that fits: k fills the sequence, or no two lengths fit beside j.
    * {j, k, b}, b the largest that fits beside j and k: no three lengths fit beside j, and
      no two fit of which the smaller is above b.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[Pattern] = []

    def take(*used: int) -> bool:
        need = {s: used.count(s) for s in used}
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                sizes.remove(s)
        fixed.append(Pattern(used, times))
        return True

    def smallest(n: int, above: int = 0) -> int | None:
        """Sum of the n smallest open lengths above a bound; None if there are fewer."""
        total = 0
        for i in range(bisect_right(sizes, above), len(sizes)):
            use = min(n, left[sizes[i]])
            total, n = total + use * sizes[i], n - use
            if not n:
                return total
        return None

    def largest(room: int, but: tuple[int, ...]) -> int | None:
        i = bisect_right(sizes, room) - 1
        while i >= 0 and left[sizes[i]] <= but.count(sizes[i]):
            i -= 1
        return sizes[i] if i >= 0 else None

    def fits(n: int, room: int, above: int = 0) -> bool:
        total = smallest(n, above)
        return total is not None and total <= room

    def fix(j: int) -> bool:
        room = capacity - j
        k = largest(room, (j,))
        if k is None:
            return take(j)
        if k == room or not fits(2, room):
            return take(j, k)
        b = largest(room - k, (j, k))
        return b is not None and not fits(3, room) and not fits(2, room, b) and take(j, k, b)

    changed = True
    while changed:  # each round fixes at least all pieces of one length, or is the last
        changed = False
        for j in reversed(list(sizes)):
            while left[j] and fix(j):
                changed = True
    return fixed, {s: n for s, n in left.items() if n}


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, many equal pieces at a time: each sequence in turn, the one with
    the least room that suffices first, takes as many of the length as fit."""
    rooms: list[int] = []  # ascending, distinct
    open_at: dict[int, list[list]] = {}  # room -> [sizes, times] groups

    def put(room: int, sizes: tuple[int, ...], times: int) -> None:
        if times:
            if room not in open_at:
                insort(rooms, room)
                open_at[room] = []
            open_at[room].append([sizes, times])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                sizes, times = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(i)
            else:
                room, sizes, times = capacity, (), n
            each = room // size
            full = min(times, n // each)
            n -= full * each
            put(room - each * size, sizes + (size,) * each, full)
            some = n if full < times and n < each else 0
            if some:
                put(room - some * size, sizes + (size,) * some, 1)
                n = 0
            if sizes:
                put(room, sizes, times - full - bool(some))
    return [Pattern(tuple(sizes), times) for groups in open_at.values() for sizes, times in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Slots(NamedTuple):
    """Where the pieces of each length go: piece number r of a length, from 0, belongs to the
    last run of the length that starts at or below r; runs are in order of (length, start)."""

    key: np.ndarray  # length << 44 | start of the run
    start: np.ndarray
    sequence: np.ndarray  # of the run's first piece; each next piece is in the next sequence
    offset: np.ndarray


def slots(patterns: list[Pattern]) -> Slots:
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for sizes, times in patterns:
        offset = 0
        for s in sizes:
            rows.append((s, used.get(s, 0), sequence, offset))
            used[s] = used.get(s, 0) + times
            offset += s
        sequence += times
    rows.sort()
    size, start, first, offset = (np.array(c, np.int64) for c in (zip(*rows) if rows else ((), (), (), ())))
    return Slots((size << 44) | start, start, first, offset)


# --- the jobs -----------------------------------------------------------------


def pieces(docs: DataFrame, path: str, ranks_path: str | None, pattern: str | None, end_id: int | None, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Cut documents, with the number of each piece among those of its task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path, ranks_path, pattern), TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                own, rows = [], []
                some = batch.slice(lo, 512)
                for i in range(some.num_rows):
                    ids = enc.encode(some.column(1)[i].as_py() or "")
                    if end_id is not None:
                        ids.append(end_id)
                    raw = np.array(ids, "<u4")
                    for number, (start, length) in enumerate(cut(len(ids), capacity)):
                        own.append(i)
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        rows.append((number, start, length, zlib.crc32(raw[start : start + length].tobytes()), part, rank))
                number, start, length, crc, at, rank = zip(*rows) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(own, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(at, pa.int32()), pa.array(rank, pa.int64())],
                    ["_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([chosen.schema["_id"], *T._parse_datatype_string("piece int, start long, length long, ids_crc32 long, part int, rank long").fields])
    return chosen.mapInArrow(run, schema)


def pack(
    docs: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None,
    end_id: int | None = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is one piece of the end id (none, if end_id is None).
    Null and repeated ids are kept: each row of docs is a document of its own. Only the two
    named columns are read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut_up = materialize(pieces(docs, path, ranks_path, pattern, end_id, capacity, id_col, text_col))
    by_task = cut_up.groupBy("part", "length").agg(F.count("*").alias("n"))
    # The ranks of a task's pieces of one length begin where those of the tasks before it end.
    before = by_task.select(
        "part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"),
    )
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = table.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            run = np.searchsorted(at.key, (length << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_id", "piece", "start", "length", "ids_crc32")), pa.array(at.sequence[run] + rank - at.start[run]), pa.array(at.offset[run])],
                ["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut_up.join(before, ["part", "length"]).select("_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("_rank"))
    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema).withColumnRenamed("_id", id_col)
