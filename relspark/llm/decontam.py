"""Benchmark decontamination with suffix arrays over the training documents.

Each task builds suffix arrays of its documents, a shard of bounded size at a time, on
words. They are sparse: only suffixes that begin as some benchmark suffix does can match
one, so only those are sorted. Every benchmark suffix whose beginning occurs in a shard is
then looked up there by binary search, and every suffix of the shard among those of the
benchmark, which gives its longest verbatim match.

The benchmark is dealt into blocks of bounded size. Where one holds all, a single pass
over the documents gives the result, and nothing is shuffled. A larger benchmark is one
pass for each block; a task never holds more than one, and only hits are merged by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from relspark.llm.common import materialize, passes, text_buffer
from relspark.llm.words import Words, grams, hash_words, words

WINDOW = 13
LEAD = 4  # words by which a suffix is chosen for the array, and of the shortest match that is reported
BLOCK_WORDS = 1 << 18  # of benchmark items in a block, at about 300 bytes a word
SHARD = 1 << 17  # suffixes of an array


class Deep(NamedTuple):
    """Full suffixes of a block's items, each item followed by an end mark, by ranks of their first 1, 2, 4, .. words."""

    words: np.ndarray  # hashes of all words, sorted; a word's rank is its place here and 1
    levels: list[np.ndarray]  # rank of the 2 ** k words from each place; 0 at end marks
    pairs: list[np.ndarray]  # of level k + 1: its ranks as pairs of ranks of level k, sorted
    order: np.ndarray  # places in the order of their full suffixes
    item: np.ndarray
    pos: np.ndarray


class Block(NamedTuple):
    """Benchmark items of bounded total length. Suffixes of at least `lead` words are kept by their first words, at most a window,
    each such key once, however many items share it."""

    names: list[str]  # item ids as strings, in their order
    lead: int
    leads: np.ndarray  # hashes of the first words of suffixes, sorted
    low: np.ndarray  # the first key of each lead
    high: np.ndarray  # and the one after its last
    keys: np.ndarray
    n: np.ndarray  # words of each key
    test: np.ndarray  # whether it is a window: of full length, or a whole item
    first: np.ndarray  # the suffixes of each key
    item: np.ndarray
    pos: np.ndarray  # word of the item where the suffix begins
    short: dict[int, tuple[np.ndarray, int]]  # whole items of fewer words than a lead, by their length: hashes, sorted, and the number of the first
    owners: np.ndarray  # items of each window, keys first and then short ones
    owned: np.ndarray  # where they begin


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each low up to its high."""
    size = high - low
    return np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)


def make_deep(codes: list[np.ndarray], sizes: np.ndarray) -> Deep:
    first = np.cumsum(np.concatenate([[0], sizes + 1])).astype(np.int64)
    n = int(first[-1])
    item = np.repeat(np.arange(len(codes)), sizes + 1)
    place = np.arange(n)
    rest = first[item + 1] - 1 - place  # words left
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]))
    rank = np.zeros(n, np.int32)
    rank[rest > 0] = np.searchsorted(words, np.concatenate([np.zeros(0, np.uint64), *codes])) + 1
    levels, pairs, width = [rank], [], 1
    while width < int(sizes.max(initial=0)):
        after = np.where(rest > width, levels[-1][np.minimum(place + width, n - 1)], 0).astype(np.int64)
        known, rank = np.unique(levels[-1].astype(np.int64) * (n + 1) + after, return_inverse=True)
        levels.append(rank.astype(np.int32))
        pairs.append(known)
        width *= 2
    return Deep(words, levels, pairs, np.argsort(levels[-1], kind="stable"), item, place - first[item])


def make_block(rows: list[tuple[str, str]], window: int) -> tuple[Block, Deep]:
    rows = sorted(rows)
    names = sorted({name for name, _ in rows})
    number = {name: i for i, name in enumerate(names)}
    owner = np.array([number[name] for name, _ in rows], np.int64)
    codes = [hash_words(text) for _, text in rows]
    sizes = np.array([len(c) for c in codes], np.int64)
    code, first = np.concatenate([np.zeros(0, np.uint64), *codes]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    lead = min(LEAD, window)
    found = Words(code, first)
    own, at = grams(found, lead)
    rest = first[found.doc[at] + 1] - at
    keyed = keys(code, at, rest, window)
    order = np.argsort(keyed, kind="stable")
    keyed, own, at, rest = keyed[order], own[order], at[order], rest[order]
    item, pos = owner[found.doc[at]], at - first[found.doc[at]]
    new = np.concatenate([[True], keyed[1:] != keyed[:-1]]) if len(keyed) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    key = np.cumsum(new) - 1  # of each suffix
    n = np.minimum(rest[begin], window)
    lead_new = np.flatnonzero(np.concatenate([[True], own[begin][1:] != own[begin][:-1]])) if len(begin) else begin
    by_lead = np.argsort(own[begin][lead_new], kind="stable")
    window_of = (rest >= window) | (pos == 0)  # suffixes that are windows of their item
    pairs = [np.stack([key, item], 1)[window_of]]
    test = np.zeros(len(begin), bool)
    test[key[window_of]] = True
    short, base = {}, len(begin)
    for m in range(1, lead):
        few = np.flatnonzero(sizes == m)
        if len(few):
            h, _ = grams(Words(np.concatenate([codes[i] for i in few]), np.arange(len(few) + 1) * m), m)
            hashes, back = np.unique(h, return_inverse=True)
            short[m] = hashes, base
            pairs.append(np.stack([back + base, owner[few]], 1))
            base += len(hashes)
    both = np.unique(np.concatenate(pairs), axis=0)
    deep = make_deep(codes, sizes)
    block = Block(
        names, lead, own[begin][lead_new][by_lead], lead_new[by_lead], np.append(lead_new[1:], len(begin))[by_lead] if len(begin) else begin, keyed[begin], n, test,
        np.append(begin, len(keyed)), item, pos, short, both[:, 1], np.searchsorted(both[:, 0], np.arange(base + 1)),
    )
    return block, deep._replace(item=owner[deep.item] if len(owner) else deep.item)


def keys(code: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """For each place the next words, n of them and at most window, as a byte string in whose
    order an array of suffixes is sorted. No word's last byte is 0, so shorter ones come first."""
    if not len(start):
        return np.zeros(0, f"S{8 * window}")
    at = start[:, None] + np.arange(window)
    there = np.arange(window) < n[:, None]
    rows = np.where(there, code[np.minimum(at, len(code) - 1)] | np.uint64(1), 0).astype(">u8")
    return np.ascontiguousarray(rows).view(f"S{8 * window}").ravel()


def beyond(own: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """The last of all keys that begin with the first n words of these."""
    rows = np.ascontiguousarray(own).view(">u8").reshape(-1, window).copy()
    rows[np.arange(window) >= n[:, None]] = 0xFFFFFFFFFFFFFFFF
    return rows.view(f"S{8 * window}").ravel()


def same_words(a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Words that keys begin with alike."""
    x, y = (np.ascontiguousarray(k).view(">u8").reshape(-1, window) for k in (a, b))
    return np.cumprod((x == y) & (x != 0), axis=1).sum(1)


class Partial(NamedTuple):
    """What one block gives for one document."""

    hit: list[tuple[int, int]]  # stretches of hit words, from and up to
    items: list[str]
    best: tuple[int, int, str, int]  # (- words, place, item, place in the item) of the longest match; the least counts


def longest(found: Words, over: np.ndarray, places: np.ndarray, deep: Deep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places whose window is met: how many words from there on stand in an item, and the suffixes that begin so, from and up
    to in their order. All words of such a match are hit, so only those are looked at.

    The length is found from its highest binary digit down: a further 2 ** k words match if, among the suffixes that match so far, which
    are in the order of what follows, some go on with the same rank."""
    at = np.flatnonzero(over)
    doc = found.doc[at]
    border = np.flatnonzero(np.concatenate([(at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]), [True]])) + 1
    end = border[np.searchsorted(border, np.arange(len(at)), side="right")]  # of each word's stretch
    word = np.minimum(np.searchsorted(deep.words, found.hash[at]), max(len(deep.words) - 1, 0))
    named = [np.where(deep.words[word] == found.hash[at], word + 1, 0)]
    for k, known in enumerate(deep.pairs):
        one, two = named[-1], np.zeros(len(at), np.int64)
        two[: max(len(at) - (1 << k), 0)] = one[1 << k :]
        pair = one * (len(deep.order) + 1) + two
        rank = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        named.append(np.where((np.arange(len(at)) + (2 << k) <= end) & (one > 0) & (two > 0) & (known[rank] == pair), rank, 0))
    i, last = np.searchsorted(at, places), len(deep.order) - 1
    length, low, high = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.full(len(i), len(deep.order))
    for k in reversed(range(len(deep.levels))):
        may = np.flatnonzero(i + length + (1 << k) <= end[i])
        may = may[named[k][(i + length)[may]] > 0]
        target, there = named[k][(i + length)[may]], length[may]
        ends = []
        for above in (0, 1):  # the first rank not below the target, and the first above it
            lo, hi = low[may].copy(), high[may].copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                value = deep.levels[k][np.minimum(deep.order[np.minimum(mid, last)] + there, last)]  # beyond the last where it is not open
                right = open_ & (value < target + above)
                lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
            ends.append(lo)
        some = ends[0] < ends[1]
        low[may[some]], high[may[some]] = ends[0][some], ends[1][some]
        length[may[some]] += 1 << k
    return length, low, high


def judge(found: Words, block: Block, deep: Deep, window: int) -> dict[int, Partial]:
    """For each document with a match of at least a lead."""
    code, place = grams(found, block.lead)
    hit = np.zeros(len(found.hash) + 1, np.int32)  # changes of the number of windows over a word
    met: list[np.ndarray] = [np.zeros(0, np.int64)]  # document and window
    full: list[np.ndarray] = [np.zeros(0, np.int64)]  # places of windows of full length
    n_windows = max(len(block.owned) - 1, 1)
    best: dict[int, tuple] = {}
    lead = np.zeros(0, np.int64)
    if len(block.leads) and len(code):
        lead = np.minimum(np.searchsorted(block.leads, code), len(block.leads) - 1)
        near = block.leads[lead] == code
        place, lead = place[near], lead[near]
    else:
        place = place[:0]
    del code

    def meet(places: np.ndarray, n: np.ndarray | int, windows: np.ndarray) -> None:
        np.add.at(hit, places, 1)
        np.add.at(hit, places + n, -1)
        met.append(np.unique(found.doc[places].astype(np.int64) * n_windows + windows))

    for lo in range(0, len(place), SHARD):
        at = place[lo : lo + SHARD]
        suffixes = keys(found.hash, at, found.first[found.doc[at] + 1] - at, window)
        order = np.argsort(suffixes, kind="stable")
        suffixes, at = suffixes[order], at[order]
        # The tests: windows of the benchmark whose leads are here. A place meets at most one of each length.
        here = np.unique(lead[lo : lo + SHARD])
        tests = ranges(block.low[here], block.high[here])
        tests = tests[block.test[tests]]
        own, n = block.keys[tests], block.n[tests]
        low = np.searchsorted(suffixes, own, side="left")
        high = np.searchsorted(suffixes, beyond(own, n, window), side="right") if len(tests) else low
        which, places = np.repeat(tests, high - low), at[ranges(low, high)]
        meet(places, block.n[which], which)
        full.append(places[block.n[which] == window])
        # The longest match of each suffix is with a neighbour in the order of the benchmark's.
        after = np.searchsorted(block.keys, suffixes)
        length = np.zeros(len(at), np.int64)
        for side in (after - 1, after):
            ok = (side >= 0) & (side < len(block.keys))
            length[ok] = np.maximum(length[ok], same_words(suffixes[ok], block.keys[side[ok]], window))
        doc = found.doc[at]
        short_ones = np.flatnonzero(length < window)
        short_ones = short_ones[np.lexsort((at[short_ones], -length[short_ones], doc[short_ones]))]
        for k in short_ones[np.unique(doc[short_ones], return_index=True)[1]]:  # the first of each document
            d = int(doc[k])
            if (-int(length[k]), int(at[k])) < best.get(d, (0, 0))[:2]:
                a = np.searchsorted(block.keys, np.bytes_(bytes(suffixes[k]).ljust(8 * window, b"\0")[: 8 * int(length[k])]))
                b = np.searchsorted(block.keys, beyond(suffixes[k : k + 1], length[k : k + 1], window)[0], side="right")
                t = slice(int(block.first[a]), int(block.first[b]))
                least = np.lexsort((block.pos[t], block.item[t]))[0]
                best[d] = (-int(length[k]), int(at[k]), block.names[block.item[t][least]], int(block.pos[t][least]))
    for n, (hashes, base) in block.short.items():
        code, where = grams(found, n)
        near = np.minimum(np.searchsorted(hashes, code), len(hashes) - 1)
        some = hashes[near] == code
        where, windows = where[some], near[some] + base
        meet(where, n, windows)
        firsts = np.unique(found.doc[where], return_index=True)[1]
        for k in firsts[np.argsort(where[firsts])]:
            d = int(found.doc[where[k]])
            best[d] = min(best.get(d, (0,)), (-n, int(where[k]), block.names[int(block.owners[block.owned[windows[k]]])], 0))
    over = np.cumsum(hit[:-1]) > 0
    places = np.unique(np.concatenate(full))
    if len(places):
        length, low, high = longest(found, over, places, deep)
        order = np.lexsort((places, -length, found.doc[places]))
        for k in order[np.unique(found.doc[places][order], return_index=True)[1]]:
            t = deep.order[low[k] : high[k]]
            least = t[np.lexsort((deep.pos[t], deep.item[t]))[0]]
            d, match = int(found.doc[places[k]]), (-int(length[k]), int(places[k]), block.names[int(deep.item[least])], int(deep.pos[least]))
            best[d] = min(best.get(d, match), match)
    best = {d: (n, at - int(found.first[d]), *rest) for d, (n, at, *rest) in best.items()}
    every = np.unique(np.concatenate(met))
    docs, begin = np.unique(every // n_windows, return_index=True)
    items: dict[int, list[str]] = {}
    known: dict[bytes, list[str]] = {}  # documents with the same windows have the same items
    for d, windows in zip(docs.tolist(), np.split(every % n_windows, begin[1:])):
        if (sign := windows.tobytes()) not in known:
            known[sign] = [block.names[i] for i in np.unique(block.owners[ranges(block.owned[windows], block.owned[windows + 1])])]
        items[d] = known[sign]
    out = {}
    for d in best.keys() | items.keys():
        own = np.concatenate([[False], over[int(found.first[d]) : int(found.first[d + 1])], [False]]).astype(np.int8)
        step = np.diff(own)
        out[d] = Partial(list(zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist())), items.get(d, []), best[d])
    return out


def merged(parts: list[Partial]) -> Partial:
    """Of several blocks."""
    if len(parts) == 1:
        return parts[0]
    hit: list[list[int]] = []
    for a, b in sorted(s for p in parts for s in p.hit):
        if hit and a <= hit[-1][1]:
            hit[-1][1] = max(hit[-1][1], b)
        else:
            hit.append([a, b])
    return Partial([tuple(h) for h in hit], sorted({i for p in parts for i in p.items}), min(p.best for p in parts))


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, match_start long, match_item string, match_item_start long"
PARTIAL = "_row long, hit array<struct<a:long,b:long>>, items array<string>, best struct<n:long,at:long,item:string,pos:long>"
NO_ITEMS = hashlib.sha256(b"").hexdigest()


def verdict(n_words: int, p: Partial | None, share: int) -> tuple:
    if p is None:
        return n_words, 0, 0, NO_ITEMS, False, 0, None, None, None
    n_hit = sum(b - a for a, b in p.hit)
    digest = hashlib.sha256(",".join(p.items).encode()).hexdigest()
    return n_words, n_hit, len(p.items), digest, n_hit > 0 and share * n_hit >= n_words, -p.best[0], *p.best[1:]


def as_batch(first: list[pa.Array], rows: list[tuple], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema.types)
    return pa.RecordBatch.from_arrays([*first, *(pa.array(c, t) for c, t in zip(columns, schema.types))], names)


RESULT_TYPES = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("d", pa.string()), ("c", pa.bool_()), ("l", pa.int64()), ("s", pa.int64()), ("i", pa.string()), ("p", pa.int64())])


def scan(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated,
    longest_match (words of the longest verbatim match; matches of fewer than LEAD words count only
    if they are whole items; 0 for none) and where it is: match_start (word of the document),
    match_item, match_item_start; null where there is none. A document is contaminated if words are
    hit, and at least one in `share` of all.

    Null texts have no words. Null and repeated doc ids are kept; items without an id or text
    take no part; rows that repeat an item id are windows of one item. Ties for the longest match go to
    the smallest place, then item. Other columns of docs are not read. Empty tables: no rows, or no hits.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text).alias("text")).where("name is not null and text is not null")
    total = bench.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")) + 1), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, int(-(-total // max_words)))
    dealt = bench.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)))

    def hold(number: int):
        """A block, of bounded size, for all tasks."""
        return spark.sparkContext.broadcast(make_block([(r["name"], r["text"]) for r in dealt.where(F.col("block") == number).select("name", "text").collect()], window))

    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    names = ["_id", *RESULT.replace(",", "").split()[::2]]
    schema = T.StructType([chosen.schema["_id"], *T._parse_datatype_string(RESULT).fields])
    if n_blocks == 1:
        held = hold(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in (s for batch in batches for s in passes(batch, "_text")):
                found = words(*text_buffer(some.column("_text")))
                parts = judge(found, *held.value, window)
                yield as_batch([some.column("_id")], [verdict(n, parts.get(d), share) for d, n in enumerate(np.diff(found.first).tolist())], RESULT_TYPES, names)

        return chosen.mapInArrow(run, schema).withColumnRenamed("_id", id_col)

    numbered = materialize(chosen.select(F.monotonically_increasing_id().alias("_row"), "_id", "_text"))  # written, so that the numbers hold
    part_type = [pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string()), pa.struct([("n", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("pos", pa.int64())])]
    hits = None
    for number in range(n_blocks):
        held = hold(number)

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for some in (s for batch in batches for s in passes(batch, "_text")):
                parts = sorted(judge(words(*text_buffer(some.column("_text"))), *held.value, window).items())
                columns = [[[{"a": a, "b": b} for a, b in p.hit] for _, p in parts], [p.items for _, p in parts], [dict(zip(("n", "at", "item", "pos"), p.best)) for _, p in parts]]
                row = some.column("_row").take(pa.array([d for d, _ in parts], pa.int64()))
                yield pa.RecordBatch.from_arrays([row, *(pa.array(c, t) for c, t in zip(columns, part_type))], ["_row", "hit", "items", "best"])

        found = materialize(numbered.select("_row", "_text").mapInArrow(find, PARTIAL))
        held.destroy()
        hits = found if hits is None else hits.unionByName(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (s for batch in batches for s in passes(batch, "_text")):
            yield pa.RecordBatch.from_arrays([some.column("_row"), some.column("_id"), pa.array(np.diff(words(*text_buffer(some.column("_text"))).first))], ["_row", "_id", "_n"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, parts in zip(batch.column("_n").to_pylist(), batch.column("parts").to_pylist()):
                each = [Partial([(h["a"], h["b"]) for h in p["hit"]], p["items"], tuple(p["best"].values())) for p in parts or ()]
                rows.append(verdict(n, merged(each) if each else None, share))
            yield as_batch([batch.column("_id")], rows, RESULT_TYPES, names)

    by_row = hits.groupBy("_row").agg(F.collect_list(F.struct("hit", "items", "best")).alias("parts"))  # one for each block at most
    counted = numbered.mapInArrow(count, T.StructType([numbered.schema["_row"], numbered.schema["_id"], T.StructField("_n", T.LongType())]))
    return counted.join(by_row, "_row", "left").select("_id", "_n", "parts").mapInArrow(finish, schema).withColumnRenamed("_id", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs that are not contaminated, with all their columns. The verdict travels beside
    the row, so null and repeated ids need no join."""
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    verdicts = scan(kept, benchmark, id_col="_row", text_col="_text", **options)
    return verdicts.where(~F.col("contaminated")).select("_row.*")
