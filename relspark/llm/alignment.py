"""Alignment of two tokenizers' tokens over the same bytes.

Each byte of a text has an owner in either tokenization: the index of its token, repeated
over the token's bytes. Where the pair of owners changes, the next overlap of two tokens
begins; where both owners change at once, both tokenizations are cut, and the tokens
between two cuts are a group. Tokens are stored as groups; how often two ids end
together in the corpus is then counted from them.

Both tokenizers encode each distinct part of the texts once for a worker: no token of either reaches
across a blank that follows another character than a blank and stands before a Latin letter, digit or mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from relspark.llm.common import materialize, passes
from relspark.llm.packing import BEYOND_LATIN, encoder

#: Characters from "!" to "~" and Latin letters are white space in no Unicode version.
CUT = re.compile("(?<! )(?= [!-~À-ɏ])")
ODD = re.compile("  | (?![!-~À-ɏ])")
SPACE = "▁"
SHORT = 1000  # characters of a part for the faster library, whose pattern fails on very long runs
STEP = 1 << 20  # bytes whose owners are looked at together, and tokens that are digested together
KNOWN_PARTS = 1 << 18  # that a worker remembers
#: Pairs of ids that are looked up in the tasks, 17 bytes each; all others are joined.
HEAD_PAIRS = 1 << 20
PENDING = 1 << 20  # distinct pairs that a task holds before it hands them on


def parts(text: str) -> list[str]:
    """Of a text that begins with a blank; each part begins with one."""
    if ODD.search(text):
        return [p for p in CUT.split(text) if p]
    return [" " + w for w in text.split(" ")[1:]]


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a byte as the character of its number if that is visible, else
    as the next one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary(NamedTuple):
    """encode: ids of many parts. bytes, ends: the tokens' bytes by id, one after the other."""

    encode: Callable[[list[str]], list[list[int]]]
    bytes: np.ndarray
    ends: np.ndarray


def vocabulary(entries: list[bytes], encode: Callable[[list[str]], list[list[int]]]) -> Vocabulary:
    return Vocabulary(encode, np.frombuffer(b"".join(entries), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64))


def byte_level(path: str, ranks_path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """A byte-level BPE of the tokenizers library; strings of special tokens are plain text. ranks_path names the same
    vocabulary for a faster library, which takes the short parts on which both surely agree."""
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(path), encoder(path, ranks_path, pattern).fast if ranks_path else None
    own.encode_special_tokens = True
    codes = byte_of_character()
    entries = [b""] * (max(own.get_vocab().values()) + 1)
    for entry, i in own.get_vocab().items():
        entries[i] = bytes(codes[c] for c in entry) if all(c in codes for c in entry) else b""

    def encode(texts: list[str]) -> list[list[int]]:
        ids = [fast.encode_ordinary(t) if fast is not None and len(t) < SHORT and not BEYOND_LATIN.search(t) else None for t in texts]
        left = [k for k, x in enumerate(ids) if x is None]
        for k, e in zip(left, own.encode_batch_fast([texts[k] for k in left], add_special_tokens=False) if left else ()):
            ids[k] = e.ids
        return ids

    return vocabulary(entries, encode)


def pieces(path: str) -> Vocabulary:
    """A sentencepiece model, which adds the first blank itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    if any(re.search(f"[^{SPACE}]{SPACE}", n) for n in names):
        raise ValueError("pieces reach across blanks, so parts cannot be encoded one by one")
    entries = [bytes([int(n[3:5], 16)]) if own.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
    return vocabulary(entries, lambda texts: own.encode([t[1:] for t in texts], num_threads=1))


_vocabularies: dict[tuple, Vocabulary] = {}
#: Path of a tokenizer; for a byte-level one also that of the same vocabulary as ranks, and their pattern.
Tokenizer = str | tuple[str, str, str]


def loaded(tokenizer: Tokenizer) -> Vocabulary:
    """Once for each worker."""
    named = (tokenizer,) if isinstance(tokenizer, str) else tuple(tokenizer)
    if named not in _vocabularies:
        _vocabularies[named] = pieces(*named) if named[0].endswith(".model") else byte_level(*named)
    return _vocabularies[named]


class Encoded:
    """Ids of the parts met so far, by either vocabulary."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.sides = (a, b)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32)] * 2
        self.ends = [np.zeros(1, np.int64)] * 2

    def look_up(self, found: list[str]) -> np.ndarray:
        new = [p for p in dict.fromkeys(found) if p not in self.index]
        if len(self.index) + len(new) > KNOWN_PARTS and self.index:
            self.clear()
            new = list(dict.fromkeys(found))
        if new:
            for k, side in enumerate(self.sides):
                ids = side.encode(new)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                self.ids[k] = np.concatenate([self.ids[k], np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
                self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(sizes)])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        return np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))

    def tokens(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts one after the other, and how many each has."""
        return gather(self.ids[k], self.ends[k], at)


def gather(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches `at` of values one after the other, and their sizes."""
    sizes = ends[at + 1] - ends[at]
    place = np.arange(sizes.sum()) + np.repeat(ends[at] - (np.cumsum(sizes) - sizes), sizes)
    return values[place], sizes


def totals(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the stretches between ends."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[ends[1:]] - sums[ends[:-1]]


def owners(a_ends: np.ndarray, b_ends: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the byte offsets at which the tokens of either side end (both lists reach the same last one):
    the token indices of all overlaps of two tokens, and the first tokens of all groups."""
    n = int(a_ends[-1]) if len(a_ends) else 0
    met: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    before = [-1, -1]
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        own = []
        for ends in (a_ends, b_ends):
            i, j = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(ends, hi - 1, side="right")) + 1
            borders = np.clip(ends[i:j], lo, hi)
            own.append(np.repeat(np.arange(i, j), np.diff(borders, prepend=lo)))
        changed = [np.diff(o, prepend=last) != 0 for o, last in zip(own, before)]
        before = [o[-1] for o in own]
        new, both = changed[0] | changed[1], changed[0] & changed[1]
        for place, value in enumerate((own[0][new], own[1][new], own[0][both], own[1][both])):
            met[place].append(value)
    a, b, first_a, first_b = (np.concatenate(m) for m in met)
    return a, b, first_a, first_b


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), pa.array(values.astype(np.int32), pa.int32())).cast(pa.list_(pa.int32()))


def align_texts(texts: pa.Array, encoded: Encoded) -> dict[str, pa.Array]:
    """Columns of `align` for some texts."""
    whole = [" " + t if t else "" for t in texts.to_pylist()]
    split = [parts(t) if t else [] for t in whole]
    at = encoded.look_up(list(chain.from_iterable(split)))
    part_ends = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    raw = [t.encode() for t in whole]
    ids, byte_sizes, counts = [], [], []
    good = np.array([bool(t) for t in whole], bool)
    for k, side in enumerate(encoded.sides):
        own, sizes = encoded.tokens(k, at)
        text, lengths = gather(side.bytes, side.ends, own)
        n = totals(sizes, part_ends)
        token_ends = np.concatenate([[0], np.cumsum(n)])
        byte_ends = np.concatenate([[0], np.cumsum(lengths)])[token_ends]
        for d in np.flatnonzero(good):
            good[d] = text[byte_ends[d] : byte_ends[d + 1]].tobytes() == raw[d]
        ids.append(own)
        byte_sizes.append(lengths)
        counts.append(n)
    kept = [np.repeat(good, n) for n in counts]
    ids, byte_sizes, counts = ([x[m] for x, m in zip(ids, kept)], [x[m] for x, m in zip(byte_sizes, kept)], [np.where(good, n, 0) for n in counts])
    a, b, first_a, first_b = owners(*(np.cumsum(s) for s in byte_sizes))
    doc_ends = [np.concatenate([[0], np.cumsum(n)]) for n in counts]
    group_ends = np.searchsorted(first_a, doc_ends[0])
    overlap_ends = np.searchsorted(a, doc_ends[0])
    return {
        "a_ids": lists(ids[0], counts[0]), "b_ids": lists(ids[1], counts[1]),
        "group_a": lists(np.diff(first_a, append=len(ids[0])), np.diff(group_ends)), "group_b": lists(np.diff(first_b, append=len(ids[1])), np.diff(group_ends)),
        "overlap_a": lists(a - np.repeat(doc_ends[0][:-1], np.diff(overlap_ends)), np.diff(overlap_ends)),
        "overlap_b": lists(b - np.repeat(doc_ends[1][:-1], np.diff(overlap_ends)), np.diff(overlap_ends)),
    }


ALIGNED = ("a_ids", "b_ids", "group_a", "group_b")
OVERLAPS = ("overlap_a", "overlap_b")


def align(docs: DataFrame, a: Tokenizer, b: Tokenizer, id_col: str = "doc_id", text_col: str = "text", overlaps: bool = False) -> DataFrame:
    """One row for each row of docs: id_col; a_ids, b_ids: the ids of a blank and the text; group_a,
    group_b: how many tokens of either side each group between two common ends has; with overlaps also overlap_a, overlap_b:
    the indices of all pairs of tokens that share bytes, in order, and always n_overlaps, their number.

    A text that is null or empty, or whose tokens' bytes are not those of a blank and the text, has no tokens. Null and repeated ids are
    kept, a row each; other columns are not read; an empty table gives an empty result.
    """
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    names = [*ALIGNED, *(OVERLAPS if overlaps else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = Encoded(loaded(a), loaded(b))
        for some in (s for batch in batches for s in passes(batch, "_text")):
            made = align_texts(some.column("_text"), encoded)
            n = pa.array(np.diff(made["overlap_a"].offsets.to_numpy()).astype(np.int64))
            yield pa.RecordBatch.from_arrays([some.column("_id"), *(made[c] for c in names), n], ["_id", *names, "n_overlaps"])

    schema = T.StructType([chosen.schema["_id"], *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in names), T.StructField("n_overlaps", T.LongType())])
    return chosen.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def id_type(a: Tokenizer, b: Tokenizer) -> np.dtype:
    """Of ids in stored links."""
    return np.dtype(np.uint16 if max(len(loaded(t).ends) for t in (a, b)) <= 1 << 16 else np.uint32)


def stored_links(a: np.ndarray, b: np.ndarray, counts: np.ndarray, kind: np.dtype) -> pa.Array:
    """For each row the ids of its links as bytes: of the first token, of the second, and so on."""
    flat = np.stack([a, b], 1).astype(kind)
    ends = np.concatenate([[0], np.cumsum(counts)]) * 2 * kind.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def link_slices(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a batch, some at a time, with the pairs of ids of all their links (a << 32 | b) and the ends of each row's."""
    for some in passes(batch, "links"):
        data, ends = binary_buffer(some.column("links"))
        ids = data.view(kind).reshape(-1, 2)
        yield some, (ids[:, 0].astype(np.int64) << 32) | ids[:, 1], ends // (2 * kind.itemsize)


def binary_buffer(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in one array, and n + 1 offsets."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)), ends - ends[0]


def count_links(aligned: DataFrame, kind: np.dtype) -> DataFrame:
    """(pair, n, best): how many links of the corpus each pair of ids has (a << 32 | b), and whether no pair of its b has more.
    Counted in the tasks first, so that a frequent pair is one row of each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, pairs, _ in (s for batch in batches for s in link_slices(batch, kind)):
            pair, n = np.unique(pairs, return_counts=True)
            held, back = np.unique(np.concatenate([held, pair]), return_inverse=True)
            times = np.bincount(back, np.concatenate([times, n]), len(held)).astype(np.int64)
            if len(held) > PENDING:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(times)], ["pair", "n"])
                held, times = held[:0], times[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(times)], ["pair", "n"])

    counted = aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << 32) - 1)))  # at most a vocabulary of rows each
    return counted.withColumn("best", F.col("n") == top)


def frequent(links: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The pairs in two parts: at most `size` of the most frequent ones, and all others."""
    step = F.floor(F.log2("n") * 10).cast("int")
    room, least = size, None
    for r in links.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).orderBy(F.desc("step")).collect():  # some hundred rows
        if r["pairs"] > room:
            break
        room, least = room - r["pairs"], r["step"]
    chosen = F.lit(False) if least is None else step >= least
    return links.where(chosen), links.where(~chosen)


def written_ids(size: int) -> np.ndarray:
    """Ids below size as text with `,`, then with `|`, then with `;` behind them."""
    return np.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], object)


def digest(ids: list[np.ndarray], ends: list[np.ndarray], texts: np.ndarray) -> str:
    """Hash of one row's groups as text; ends: of its groups in its ids."""
    size = len(texts) // 3
    group = [np.repeat(np.arange(len(e)), np.diff(e, prepend=0)) for e in ends]
    codes = np.empty(len(ids[0]) + len(ids[1]), np.int32)
    for k, mark in enumerate((1, 2)):
        code = ids[k].astype(np.int32)
        code[ends[k] - 1] += mark * size
        other = np.concatenate([[0], ends[1 - k]])[group[k] + k]  # tokens of the other side that stand before
        codes[np.arange(len(code)) + other] = code
    out = hashlib.sha256()
    for lo in range(0, len(codes), STEP):
        part = "".join(texts[codes[lo : lo + STEP]].tolist())
        out.update((part[:-1] if lo + STEP >= len(codes) else part).encode())
    return out.hexdigest()


def links_of(docs: DataFrame, a: Tokenizer, b: Tokenizer, kind: np.dtype) -> DataFrame:
    """For rows (row, id, text) what `align` finds, in short: row, id, n_a, n_b, n_groups, n_overlaps, groups_sha256, links."""
    numbers = ("n_a", "n_b", "n_groups", "n_overlaps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [loaded(t) for t in (a, b)]
        encoded, texts = Encoded(*sides), written_ids(max(len(v.ends) for v in sides))
        for some in (s for batch in batches for s in passes(batch, "text")):
            made = align_texts(some.column("text"), encoded)
            flat = {c: (made[c].flatten().to_numpy(zero_copy_only=False), made[c].offsets.to_numpy().astype(np.int64)) for c in ALIGNED}
            rows = flat["group_a"][1]
            # Where groups end, in the ids of all rows and then in those of each row.
            whole = [np.cumsum(flat[c][0], dtype=np.int64) for c in ("group_a", "group_b")]
            last = [flat[c][0][e - 1] for c, e in zip(("a_ids", "b_ids"), whole)]
            hashes = []
            for d, (lo, hi) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
                own = [(flat[c][0][flat[c][1][d] : flat[c][1][d + 1]], e[lo:hi] - flat[c][1][d]) for c, e in zip(("a_ids", "b_ids"), whole)]
                hashes.append(digest([i for i, _ in own], [e for _, e in own], texts) if hi > lo else "")
            counts = [np.diff(x) for x in (flat["a_ids"][1], flat["b_ids"][1], rows, made["overlap_a"].offsets.to_numpy())]
            yield pa.RecordBatch.from_arrays(
                [some.column("row"), some.column("id"), *(pa.array(n.astype(np.int64)) for n in counts), pa.array(hashes, pa.string()), stored_links(*last, counts[2], kind)],
                ["row", "id", *numbers, "groups_sha256", "links"],
            )

    schema = T.StructType([docs.schema["row"], docs.schema["id"], *(T.StructField(c, T.LongType()) for c in numbers), T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def summarize(docs: DataFrame, a: Tokenizer, b: Tokenizer, id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """One row for each row of docs: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, n_overlaps, groups_sha256.

    A link is a token of either side that end together: the last two of each group. Its count is how many links of the corpus have its ids.
    n_best: links whose count no pair with the same id of the second side exceeds. A row without tokens has zeros
    and an empty digest; see `align` for the rest.

    The counts of at most head_pairs pairs, the most frequent, are looked up in the tasks; all others are joined, and
    none of those holds more than about one in head_pairs of all links, so no key of the join is hot.
    """
    spark, kind = docs.sparkSession, id_type(a, b)
    aligned = materialize(links_of(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), a, b, kind))  # read twice
    links = materialize(count_links(aligned, kind))
    head, tail = frequent(links, head_pairs)
    known = head.orderBy("pair").toArrow()
    held = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "n", "best")))
    kept = ("n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row of docs one with what the head gives; and one for each other pair of it."""
        pairs, times, best = held.value
        for some, own, ends in (s for batch in batches for s in link_slices(batch, kind)):
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            here = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            n, top = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            n[here], top[here] = times[at[here]], best[at[here]]
            rest = np.flatnonzero(~here)
            row = np.repeat(np.arange(some.num_rows), np.diff(ends))[rest]
            order = np.lexsort((own[rest], row))
            row, pair = row[order], own[rest][order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])) if len(row) else np.zeros(0, np.int64)
            again = pa.array(np.concatenate([np.arange(some.num_rows), row[first]]))
            only = pa.array(np.concatenate([np.arange(some.num_rows), np.full(len(first), -1)]), mask=np.arange(some.num_rows + len(first)) >= some.num_rows)
            none, nulls = pa.nulls(some.num_rows, pa.int64()), pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [some.column("row").take(again), *(some.column(c).take(only) for c in ("id", *kept)),
                 pa.concat_arrays([none, pa.array(pair[first])]), pa.concat_arrays([none, pa.array(np.diff(first, append=len(row)))]),
                 *(pa.concat_arrays([pa.array(totals(x, ends)), nulls]) for x in (top, n))],
                ["row", "id", *kept, "pair", "times", "n_best", "count_sum"],
            )

    long = T.LongType()
    schema = T.StructType([*(aligned.schema[c] for c in ("row", "id", *kept)), *(T.StructField(c, long) for c in ("pair", "times", "n_best", "count_sum"))])
    # Rows without a pair meet nothing; the salt deals them out instead of to one task.
    made = aligned.mapInArrow(run, schema).withColumn("salt", F.when(F.col("pair").isNull(), F.col("row") % 8192).otherwise(F.lit(0).cast("long")))
    met = made.join(tail.select("pair", "n", "best").withColumn("salt", F.lit(0).cast("long")), ["pair", "salt"], "left")
    total = lambda own, more: (F.sum(F.coalesce(own, F.lit(0).cast("long"))) + F.sum(F.coalesce(more, F.lit(0).cast("long")))).cast("long")
    out = met.groupBy("row").agg(
        F.first("id", ignorenulls=True).alias(id_col), *(F.max(c).alias(c) for c in kept),
        total(F.col("n_best"), F.when(F.col("best"), F.col("times"))).alias("n_best"), total(F.col("count_sum"), F.col("n") * F.col("times")).alias("count_sum"),
    )
    return out.select(id_col, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "n_overlaps", "groups_sha256")
