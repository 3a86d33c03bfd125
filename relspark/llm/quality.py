"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of characters and words in it and in
the lines before and after it; neighbouring labels are tied by a transition score. The
forward-backward marginals of a document's lines, weighted by their lengths, are its score.

The field is trained by maximum likelihood on a bounded sample of labelled documents. At
first their lines all take the document's label; then each line takes the label that the
field finds likelier, unless that contradicts its document, and the field is fitted again.

Long texts are read in blocks of lines, and long chains in pieces whose messages are
carried from one to the next, so memory is a few numbers a line beside the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from relspark.llm.common import passes, text_buffer
from relspark.llm.words import words

#: Bounds of the sample that the field is trained on: labelled documents, and lines of each. A document
#: of more lines gives runs of RUN_LINES lines, evenly spread over it.
SAMPLE_DOCS, SAMPLE_LINES, RUN_LINES = 4_000, 512, 64
THRESHOLD, RIDGE, RATE = 0.3, 1e-3, 0.1
#: Steps of the fit to the documents' labels, and of the fit to the lines' own.
ROUNDS = (150, 100)
#: Bytes and lines that one numpy pass looks at, and lines of a piece of a chain.
BLOCK_BYTES, BLOCK_LINES, PIECE = 1 << 20, 1 << 16, 1 << 10

#: Classes of bytes: other, lower case and beyond ASCII, upper case, digit, blank, sentence marks, exclamation, other marks
KIND = np.zeros(256, np.uint8)
KIND[97:123] = KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 3
KIND[[9, 32]] = 4
KIND[[ord(c) for c in ".,;:'-()?\""]] = 5
KIND[ord("!")] = 6
KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7
N_FEATURES = 15


class Bounds(NamedTuple):
    """Byte offsets of all lines, without their line feeds. Every document has a line at least, an empty one if it is empty."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first line of each document; one more entry than documents


class Lines(NamedTuple):
    features: np.ndarray  # n x N_FEATURES
    weight: np.ndarray  # bytes, with the line feed
    first: np.ndarray


def bounds(data: np.ndarray, offsets: np.ndarray) -> Bounds:
    step = 1 << 24
    feeds = np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero(data[lo : lo + step] == 10) + lo for lo in range(0, len(data), step))])
    first = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(feeds, offsets)) + 1)])
    heads = np.zeros(first[-1], bool)
    heads[first[:-1]] = True
    start = np.empty(first[-1], np.int64)
    start[heads], start[~heads] = offsets[:-1], feeds + 1
    tails = np.zeros(first[-1], bool)
    tails[first[1:] - 1] = True
    end = np.empty_like(start)
    end[tails], end[~tails] = offsets[1:], feeds
    return Bounds(start, end, first)


def blocks(at: Bounds, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Lines lo to hi in groups of bounded bytes and number; a longer line is a group of its own."""
    while lo < hi:
        stop = max(lo + 1, min(hi, lo + BLOCK_LINES, int(np.searchsorted(at.end, at.start[lo] + BLOCK_BYTES, side="right"))))
        yield lo, stop
        lo = stop


def features(data: np.ndarray, at: Bounds, a: int, b: int) -> np.ndarray:
    """Of lines a to b, which stand next to each other."""
    base = at.start[a]
    start, end = at.start[a:b] - base, at.end[a:b] - base
    size = end - start
    text = data[base : at.end[b - 1]]
    counts = np.zeros((b - a) * 8, np.int64)
    for lo in range(0, len(text), BLOCK_BYTES):
        part = text[lo : lo + BLOCK_BYTES]
        line = np.searchsorted(start, np.arange(lo, lo + len(part)), side="right") - 1 if b - a > 1 else 0
        kept = part != 10
        counts += np.bincount((line * 8 + KIND[part])[kept], minlength=len(counts))
    counts = counts.reshape(-1, 8).astype(float)
    found = words(text, np.append(start, len(text)))
    n = np.diff(found.first)
    distinct, again = repeats(found.hash, found.first)
    some, n_words = np.maximum(size, 1), np.maximum(n, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(n), *(counts[:, k] / some for k in (1, 2, 3, 4, 5, 6, 7)),
        (counts[:, 1] + counts[:, 2] + counts[:, 3]) / n_words / 10, np.log1p(distinct), distinct / n_words, again / n_words, counts[:, 7] / n_words, size == 0,
    ])


def lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """All lines of documents that are not long."""
    at = bounds(data, offsets)
    parts = [features(data, at, a, b) for a, b in blocks(at, 0, len(at.start))]
    return Lines(np.vstack(parts) if parts else np.zeros((0, N_FEATURES)), at.end - at.start + 1, at.first)


def repeats(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line, its distinct words and the words that equal the one before. first: each line's first word."""
    n = len(first) - 1
    line = np.repeat(np.arange(n, dtype=np.uint32), np.diff(first))
    if not len(line):
        return np.zeros(n), np.zeros(n)
    same = np.zeros(len(line), bool)
    same[1:] = (code[1:] == code[:-1]) & (line[1:] == line[:-1])
    # a line's words have its number in the upper bits: 40 bits tell the words of a line apart
    order = (line.astype(np.uint64) << np.uint64(40)) | (code & np.uint64((1 << 40) - 1))
    order.sort()
    fresh = np.concatenate([[True], order[1:] != order[:-1]])
    return np.bincount(order[fresh] >> np.uint64(40), minlength=n).astype(float), np.bincount(line[same], minlength=n).astype(float)


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it (zero where there is none), and one."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def forward_backward(
    logit: np.ndarray, first: np.ndarray, tie: np.ndarray, inside: np.ndarray | None = None, entry: np.ndarray | None = None, leave: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of (bad, good) for each line, expected transitions in all, and log of each
    document's sum over labelings. logit: of good against bad, by line alone; tie: 2 x 2.

    For pieces of chains: entry, the message from the line before, for those that are `inside`
    their chain, and leave, the message to the last line from those after it."""
    local = np.stack([np.zeros_like(logit), logit], 1)
    top = local.max(1)
    local = np.exp(local - top[:, None])
    move = np.exp(tie)
    order = np.argsort(-np.diff(first), kind="stable")
    start, size = first[:-1][order], np.diff(first)[order]
    alpha, beta = np.empty_like(local), np.empty_like(local)
    scale = np.ones(len(logit))
    steps = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]  # documents with over t lines
    for t in range(steps):
        at = start[: active[t]] + t
        value = local[at] if t == 0 else (alpha[at - 1] @ move) * local[at]
        if t == 0 and entry is not None:
            value = np.where(inside[order][:, None], entry[order] @ move, 1.0) * value
        scale[at] = value.sum(1)
        alpha[at] = value / scale[at][:, None]
    pairs = np.zeros((2, 2))
    beta[first[1:] - 1] = 1.0 if leave is None else leave
    for t in range(steps - 1, 0, -1):
        at = start[: active[t]] + t
        ahead = local[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = ahead @ move.T
        pairs += (alpha[at - 1].T @ ahead) * move
    marginal = alpha * beta
    return marginal / marginal.sum(1, keepdims=True), pairs, np.add.reduceat(np.log(scale) + top, first[:-1]) if len(logit) else np.zeros(0)


def transfers(logit: np.ndarray, first: np.ndarray, tie: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """For each piece the 2 x 2 matrix that carries a message from before it to its last line, up to a factor."""
    move, size = np.exp(tie), np.diff(first)
    out = np.repeat(np.eye(2)[None], len(size), 0)
    for t in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > t)
        own = np.stack([np.zeros(len(on)), logit[first[:-1][on] + t]], 1)
        own = np.exp(own - own.max(1, keepdims=True))
        step = out[on] if t == 0 else out[on] @ move
        if t == 0:
            step[inside[on]] = move
        step = step * own[:, None, :]
        out[on] = step / step.sum((1, 2), keepdims=True)
    return out


def good_shares(logit: np.ndarray, weight: np.ndarray, first: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """For each document the marginals of its lines being good, weighted. Long chains are cut into pieces."""
    n_pieces = -(-np.diff(first) // PIECE)
    doc = np.repeat(np.arange(len(n_pieces)), n_pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    cut = np.append(first[:-1][doc] + number * PIECE, first[-1])
    inside = number > 0
    groups = [(lo, min(lo + BLOCK_LINES // PIECE, len(doc))) for lo in range(0, len(doc), BLOCK_LINES // PIECE)] if inside.any() else [(0, len(doc))]
    entry, leave = np.ones((len(doc), 2)), np.ones((len(doc), 2))
    if inside.any():
        carry = np.concatenate([transfers(logit[cut[a] : cut[b]], cut[a : b + 1] - cut[a], tie, inside[a:b]) for a, b in groups])
        for k in np.flatnonzero(inside).tolist():
            entry[k] = entry[k - 1] @ carry[k - 1]
            entry[k] /= entry[k].sum()
        for k in np.flatnonzero(inside)[::-1].tolist():
            leave[k - 1] = carry[k] @ leave[k]
            leave[k - 1] /= leave[k - 1].sum()
    total = np.zeros(len(n_pieces))
    for a, b in groups:
        own = slice(cut[a], cut[b])
        good = forward_backward(logit[own], cut[a : b + 1] - cut[a], tie, inside[a:b], entry[a:b], leave[a:b])[0][:, 1]
        np.add.at(total, doc[a:b], np.add.reduceat(good * weight[own], cut[a:b] - cut[a]) if b > a else 0.0)
    return total / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else total


class Field(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    tie: np.ndarray

    def logits(self, parts: Iterator[tuple[int, np.ndarray]], first: np.ndarray) -> np.ndarray:
        """Of all lines, from the features of blocks of them (number of the first line, features)."""
        n = int(first[-1])
        own, before, after = self.weights[:-1].reshape(3, -1)
        logit = np.full(n, self.weights[-1])
        heads, tails = np.zeros(n + 1, bool), np.zeros(n, bool)
        heads[first[:-1]], tails[first[1:] - 1] = True, True
        for a, x in parts:
            x = (x - self.mean) / self.spread
            b = a + len(x)
            logit[a:b] += x @ own
            to = min(b + 1, n)  # a line's features go to the next line of its document, too, and to the one before
            logit[a + 1 : to] += np.where(heads[a + 1 : to], 0.0, (x @ before)[: to - a - 1])
            since = max(a - 1, 0)
            logit[since : b - 1] += np.where(tails[since : b - 1], 0.0, (x @ after)[since + 1 - a :])
        return logit

    def scores(self, found: Lines) -> np.ndarray:
        return good_shares(self.logits(iter([(0, found.features)]), found.first), found.weight, found.first, self.tie)

    def text_scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of texts of any length, read in blocks of lines."""
        at = bounds(data, offsets)
        logit = self.logits(((a, features(data, at, a, b)) for a, b in blocks(at, 0, len(at.start))), at.first)
        return good_shares(logit, at.end - at.start + 1, at.first, self.tie)


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray) -> Field:
    """Maximum likelihood with a ridge, by gradient steps of adapted size (Adam), on the features of
    chains of lines and a label for each; then once more on labels of the lines' own."""
    if not len(x):
        return Field(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)))
    weight = np.expm1(x[:, 0]) + 1
    mean, spread = x.mean(0), x.std(0) + 1e-6
    x = with_neighbours((x - mean) / spread, first)
    chain = np.repeat(np.arange(len(label)), np.diff(first))
    theta = np.zeros(x.shape[1] + 4)
    whole = y = label[chain].astype(np.int64)
    follows = np.flatnonzero(chain[1:] == chain[:-1])
    for rounds in ROUNDS:
        seen = np.bincount(y[follows] * 2 + y[follows + 1], minlength=4).astype(float).reshape(2, 2)
        m = v = 0.0
        for step in range(1, rounds + 1):
            marginal, pairs, _ = forward_backward(x @ theta[:-4], first, theta[-4:].reshape(2, 2))
            slope = np.concatenate([x.T @ (marginal[:, 1] - y), (pairs - seen).ravel()]) / len(label) + RIDGE * theta
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        marginal = forward_backward(x @ theta[:-4], first, theta[-4:].reshape(2, 2))[0]
        own = (marginal[:, 1] > 0.5).astype(np.int64)
        share = np.bincount(chain, own * weight, len(label)) / np.bincount(chain, weight, len(label))
        y = np.where((share > 0.5)[chain] == (whole == 1), own, whole)
    return Field(mean, spread, theta[:-4], theta[-4:].reshape(2, 2))


def sample_runs(n: int, most: int = SAMPLE_LINES, run: int = RUN_LINES) -> list[tuple[int, int]]:
    """Of n lines, all, or runs evenly spread over them."""
    if n <= most:
        return [(0, n)]
    return [(int(a), int(a) + run) for a in np.linspace(0, n - run, most // run).astype(np.int64)]


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Trains on at most sample_docs labelled documents of any length, those whose ids hash lowest,
    and at most SAMPLE_LINES lines of each. Rows with crc32(doc_id as text) mod 5 = 0 are held out.
    Labels that are null, or differ for one id, are not used; of several texts with one id the one
    whose hash is least is. Null texts count as empty."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where("label = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).select("doc_id", "label")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in passes(batch, "_text"):
                data, offsets = text_buffer(some.column("_text"))
                at, parts = bounds(data, offsets), []
                for a, b in zip(at.first[:-1], at.first[1:]):
                    runs = [(a + lo, a + hi) for lo, hi in sample_runs(int(b - a))]
                    parts.append([np.vstack([features(data, at, *x) for x in blocks(at, *r)]).astype("<f4").tobytes() for r in runs])
                yield pa.RecordBatch.from_arrays([some.column("label"), some.column("doc_id"), some.column("_key"), pa.array(parts, pa.list_(pa.binary()))], [f.name for f in schema.fields])

    texts = docs.select("doc_id", F.col("text").alias("_text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("_text").alias("_key"), "_text")  # at most sample_docs rows of chosen
    schema = T.StructType([T.StructField("label", T.IntegerType()), sample.schema["doc_id"], T.StructField("_key", T.LongType()), T.StructField("features", T.ArrayType(T.BinaryType()))])
    rows = sample.mapInArrow(run, schema).groupBy("doc_id").agg(F.min(F.struct("_key", "label", "features")).alias("r")).select("doc_id", "r.label", "r.features").collect()
    rows.sort(key=lambda r: r["doc_id"])
    each = [(np.frombuffer(f, "<f4").reshape(-1, N_FEATURES).astype(float), r["label"]) for r in rows for f in r["features"]]
    first = np.concatenate([[0], np.cumsum([len(x) for x, _ in each])]).astype(int)
    return fit(np.vstack([x for x, _ in each]) if each else np.zeros((0, N_FEATURES)), first, np.array([y for _, y in each]))


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, and score (0 to 1, higher: better).

    Only the text is used. Null and empty texts are one empty line and get a score too; null
    and repeated ids are kept. Other columns are not read. An empty table gives an empty result.
    Without labelled rows in training every score is a half.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in passes(batch, "_text"):
                scores = held.value.text_scores(*text_buffer(some.column("_text")))
                yield pa.RecordBatch.from_arrays([some.column("_id"), pa.array(np.clip(scores, 0.0, 1.0))], ["_id", "score"])

    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([chosen.schema["_id"], T.StructField("score", T.DoubleType())])
    return chosen.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, field: Field, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Rows of docs that score at least the threshold, with all their columns."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    return score(whole, field, "_row", "_text").where(F.col("score") >= threshold).select("_row.*")
