"""Token counts without token ids.

Texts are cut at places where no piece of the tokenizer can reach across; the parts
are its pre-tokens (or a few of them together). Each distinct part is tokenized once,
its piece count is joined to the parts' frequencies in each document and summed.

The most frequent parts hold most places in any text, and would be hot join keys. So
the counts of a bounded head table, the ``head_size`` most frequent parts of a few
documents of each task, are looked up in the tasks; all others, whatever their number, go through the
join. The sample decides only which way a part takes, not the counts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from relspark.llm.common import materialize, passes, release

#: Parts, in this order: letters with one blank before them, up to punctuation or white
#: space; punctuation up to white space; else white space and all up to the next. A part
#: ends only before white space of every Unicode version (or before punctuation after
#: ASCII letters), and never after a character that some version calls white space.
PART = re.compile(
    r" ?[A-Za-z]+(?=[.,;:!?]*(?:[ \n\t\r]|\Z))"
    r"|[.,;:!?]+(?=[ \n\t\r]|\Z)"
    r"|[ \n\t\r]*[^ \n\t\r]+(?:(?<=\s)[ \n\t\r]+[^ \n\t\r]*)*"
    r"|[ \n\t\r]+"
)
HEAD_SIZE, SAMPLE_DOCS = 1 << 16, 256  # documents of each task

_tokenizers: dict = {}


def tokenizer(path: str):
    """The library's tokenizer of this file, once for each worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def piece_counts(path: str, parts: list[str]) -> list[int]:
    if path.endswith(".model"):
        import sentencepiece

        if path not in _tokenizers:
            _tokenizers[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(ids) for ids in _tokenizers[path].encode(parts, num_threads=1)]
    return [len(e.ids) for e in tokenizer(path).encode_batch(parts, add_special_tokens=False)]


def cuts(path: str) -> Callable[[str], list[str]]:
    """How texts are cut for a tokenizer: at PART for byte-level ones that change nothing before
    they split and whose special strings hold no white space; else a text is a single part."""
    if path.endswith(".json"):
        with open(path) as f:
            j = json.load(f)
        split, added = j.get("pre_tokenizer") or {}, j.get("added_tokens") or []
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not j.get("normalizer")
        if plain and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added):
            return PART.findall
    return lambda text: [text] if text else []


def head_table(docs: DataFrame, text: str, path: str, parts_of: Callable[[str], list[str]], head_size: int, sample_docs: int) -> dict[str, int]:
    """Counts of at most head_size parts, about the most frequent in the first sample_docs documents of each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        left = sample_docs
        for batch in batches:
            for value in batch.column(0).slice(0, left).to_pylist():
                seen.update(parts_of(value))
            left -= min(left, batch.num_rows)
            if not left:
                break
        top = seen.most_common(head_size)
        yield pa.RecordBatch.from_pydict({"part": [p for p, _ in top], "n": [n for _, n in top]})

    sample = docs.select(text).where(F.octet_length(text) < 20_000)
    counted = materialize(sample.mapInArrow(count, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")))
    # Cut by a bound on the frequency, so that tasks send the driver only parts that stay: first the
    # number of parts by frequency (steps of a tenth of an octave: some hundred rows), then the parts.
    step = F.floor(F.log2("n") * 10).cast("int")
    total, whole, rest = 0, None, None
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("parts")).orderBy(F.desc("step")).collect():
        if total + r["parts"] > head_size:
            rest = r["step"], (head_size - total) * 1_000 // r["parts"]
            break
        total, whole = total + r["parts"], r["step"]
    # Of the step that is too many, a share by hash.
    wanted = F.lit(False) if whole is None else step >= whole
    if rest is not None:
        wanted = wanted | ((step == rest[0]) & (F.pmod(F.xxhash64("part"), F.lit(1_000)) < rest[1]))
    parts = [r["part"] for r in counted.where(wanted).select("part").collect()]
    release(counted)
    return dict(zip(parts, piece_counts(path, parts))) if parts else {}


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    head_size: int = HEAD_SIZE, sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """One row for each row of docs: its id, n_bytes (UTF-8) and n_tokens.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids are kept, a
    row each. Columns other than the two named are not read, whatever their names. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"), F.col(text_col).alias("_text"))
    parts_of = cuts(path)
    head = spark.sparkContext.broadcast(head_table(base, "_text", path, parts_of, head_size, sample_docs))

    def rare_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in (some for whole in batches for some in passes(whole, "_text")):
            found: set[str] = set()
            for text in batch.column(0).to_pylist():
                found.update(parts_of(text or ""))
            yield pa.RecordBatch.from_pydict({"part": pa.array([p for p in found if p not in known], pa.string())})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document a row without a part: what the head table gives; and a row for each other part."""
        known = head.value
        for batch in (some for whole in batches for some in passes(whole, "_text")):
            rows, own, parts, freqs = [], [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                total = 0
                for part, n in Counter(parts_of(text or "")).items():
                    pieces = known.get(part)
                    if pieces is None:
                        rows.append(i)
                        own.append(None)
                        parts.append(part)
                        freqs.append(n)
                    else:
                        total += n * pieces
                rows.append(i)
                own.append(i)
                parts.append(None)
                freqs.append(total)
            own = pa.array(own, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(pa.array(rows, pa.int32())), batch.column("_id").take(own), batch.column("_bytes").take(own), pa.array(parts, pa.string()), pa.array(freqs, pa.int64())],
                ["_row", "_id", "_bytes", "part", "n"],
            )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"part": batch.column(0), "pieces": pa.array(piece_counts(path, parts) if parts else [], pa.int64())})

    vocabulary = base.select("_text").mapInArrow(rare_parts, "part string").distinct().mapInArrow(pieces, "part string, pieces long")
    freq = base.mapInArrow(frequencies, T.StructType([base.schema["_row"], base.schema["_id"], T.StructField("_bytes", T.LongType()), T.StructField("part", T.StringType()), T.StructField("n", T.LongType())]))
    # Rows without a part meet nothing; the salt deals them out instead of to one task.
    salted = freq.withColumn("salt", F.when(F.col("part").isNull(), F.col("_row") % 8192).otherwise(F.lit(0).cast("long")))
    return (
        salted.join(vocabulary.withColumn("salt", F.lit(0).cast("long")), ["part", "salt"], "left")
        .groupBy("_row")
        .agg(
            F.first("_id", ignorenulls=True).alias(id_col),
            F.max("_bytes").alias("n_bytes"),
            F.sum(F.col("n") * F.coalesce("pieces", F.lit(1).cast("long"))).alias("n_tokens"),
        )
        .drop("_row")
    )
