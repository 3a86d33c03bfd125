"""Chat formatting by columnar byte assembly.

A conversation becomes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Control
strings inside texts and roles are made harmless by doubling: every ``<|`` in a text is
written ``<||``, so ``<|im_`` never comes from a text, and reading ``<||`` as ``<|``
restores it. (A text that holds ``<||`` becomes ``<|||``, and comes back as it was.)
In a role a line feed is also written ``<|n``, as a role ends at the first line feed.

The loss mask holds the escaped texts of the assistant's turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from relspark.llm.common import text_buffer

START, END, LEARNED = "<|im_start|>", "<|im_end|>", "assistant"
#: Turns that one numpy pass assembles together; a longer conversation is a pass of its own.
PASS_TURNS, PASS_BYTES = 20_000, 4 << 20


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(texts, "<|", "<||")


def escape_role(roles: pa.Array) -> pa.Array:
    return pc.replace_substring(escape(roles), "\n", "<|n")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def unescape_role(role: str) -> str:
    return unescape(role.replace("<|n", "\n"))


def stretches(at: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Neighbouring segments of at most about `size` bytes together, or one longer one."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All conversations of a pass in one buffer. first: the first turn of each, n + 1 entries.
    Returns the formatted strings and, for each turn, the byte span of its text in its string."""
    role, role_at = text_buffer(escape_role(pc.fill_null(roles, "")))
    text, text_at = text_buffer(escape(pc.fill_null(texts, "")))
    n = len(role_at) - 1
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (START, "\n", END + "\n")]
    # five segments a turn: start mark, role, line feed, text, end mark
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = (len(x) for x in fixed)
    sizes[:, 1], sizes[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    begins = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for column, part in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[begins[:, column][:, None] + np.arange(len(part))] = part
    for column, data, at in ((1, role, role_at), (3, text, text_at)):
        for lo, hi in stretches(at):
            if hi == lo + 1:  # may be long: one plain copy
                out[begins[lo, column] : ends[lo, column]] = data[at[lo] : at[hi]]
            else:
                index = np.arange(at[lo], at[hi]) + np.repeat(begins[lo:hi, column] - at[lo:hi], sizes[lo:hi, column])
                out[index] = data[at[lo] : at[hi]]
    cuts = np.concatenate([[0], ends[:, -1]])[first]
    whole = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out))
    base = np.repeat(cuts[:-1], np.diff(first))
    return whole, begins[:, 3] - base, ends[:, 3] - base


def format_conversations(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    learned: str = LEARNED, partitions: int | None = None,
) -> DataFrame:
    """One row for each conversation: its id, formatted (string), n_turns, loss_start and
    loss_end (arrays: byte spans of the formatted string under the loss mask).

    Rows go by turn, nulls first; rows of one turn by role and text, rows alike all stay.
    Null texts and roles count as empty. Rows whose conversation is null are one conversation.
    Other columns are not read. An empty table gives an empty result.

    A conversation is a single string, so its turns meet in one task; they stream through it
    in order, and no other conversation is held with one that exceeds a pass.
    """
    rows = conversations.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"))
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")

    def finish(turns: pa.Table) -> pa.RecordBatch:
        conv = turns.column("_conv").combine_chunks()
        first = np.append(np.flatnonzero(changes(conv)), len(conv))
        roles, texts = (turns.column(c).combine_chunks() for c in ("_role", "_text"))
        whole, begin, end = assemble(roles, texts, first)
        ours = pc.equal(pc.fill_null(roles, ""), learned).to_numpy(zero_copy_only=False)
        counts = np.concatenate([[0], np.cumsum(ours)])[first].astype(np.int32)
        spans = [pa.ListArray.from_arrays(pa.array(counts), pa.array(x[ours])) for x in (begin, end)]
        return pa.RecordBatch.from_arrays([conv.take(pa.array(first[:-1])), whole.cast(pa.string()), pa.array(np.diff(first)), *spans], [f.name for f in schema.fields])

    def changes(conv: pa.Array) -> np.ndarray:
        """Where a new conversation begins."""
        new = np.ones(len(conv), bool)
        a, b = conv.slice(1), conv.slice(0, max(0, len(conv) - 1))
        if len(a):
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            new[1:] = ~same.to_numpy(zero_copy_only=False)
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < PASS_TURNS and sum(t.nbytes for t in held) < PASS_BYTES:
                continue
            turns = pa.concat_tables(held)
            last = int(np.flatnonzero(changes(turns.column("_conv").combine_chunks()))[-1])
            if last:  # the last conversation may go on in the next batch
                yield finish(turns.slice(0, last))
                turns = turns.slice(last)
            held = [turns]
        if held and (turns := pa.concat_tables(held)).num_rows:
            yield finish(turns)

    schema = T.StructType([rows.schema["_conv"], *T._parse_datatype_string("formatted string, n_turns long, loss_start array<long>, loss_end array<long>").fields])
    return dealt.mapInArrow(run, schema).withColumnRenamed("_conv", conv_col)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, text = turn[: -len(END) - 1].split("\n", 1)
        turns.append((unescape_role(role), unescape(text)))
    return turns


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for whole, begins, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                turns, raw = parse(whole), whole.encode()
                said = "".join(unescape(raw[b:e].decode()) for b, e in zip(begins, ends))
                every = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(whole)))
            columns = zip(*rows) if rows else [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [f.name for f in schema.fields])

    chosen = formatted.select(conv_col, "formatted", "loss_start", "loss_end")
    schema = T.StructType([chosen.schema[conv_col], *T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    return chosen.mapInArrow(run, schema)
