"""N-gram Jaccard join by chosen paths.

Every document is the set of its word shingles. In each of several runs a set takes the
tokens whose shared random rank is below a bound that falls with its size, and joins the
bucket of each; two sets that share most tokens share a taken one with known probability.
Buckets that are still large are split again by other ranks (a path of tokens), small ones
are compared by brute force. Runs are repeated until the target recall is reached.

What is compared is sets, not documents: documents with equal sets are one entry. Buckets
with the same smallest entry are one group, so that near copies, which meet in nearly all
their buckets, are compared once. A group is cut into blocks, and its pairs of blocks are
separate tasks. Tasks return for each entry the documents linked to it and a link to its
component's smallest entry there; pairs are never written out. A pair that meets in several
groups counts in the first of them that both entries are in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from relspark.llm.common import materialize, mix64, passes, release, text_buffer
from relspark.llm.words import STEP, grams, words

N, SIMILARITY = 5, 0.8
#: Expected number of tokens that two sets at the threshold share and take, at each level of a path.
TAKEN = (1.0, 1.5, 1.5)
TARGET_RECALL = 0.99
SMALL = 1_024  # a bucket of more entries is split, as long as paths may grow
DENSE = 0.5  # not if this share of them has one token of least rank: most pairs are links, and splitting would keep them together
BLOCK_SETS, BLOCK_TOKENS = 1_024, 1 << 19
BITS = 40  # of a token where sets are compared
RARE = 16  # tokens that fewer sets share are counted pair by pair, others by products


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold is found with this probability, even if every
    one of its buckets is split up to the last level."""
    once = math.prod(1 - math.exp(-t) for t in TAKEN)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as (text, token) in order. A text of fewer words than n,
    but not none, has one: all its words."""
    found = words(data, offsets)
    code, place = grams(found, n)
    doc = found.doc[place]
    del place
    for d in np.flatnonzero((np.diff(found.first) < n) & (np.diff(found.first) > 0)):
        part = found.hash[found.first[d] : found.first[d + 1]]
        short = np.zeros(1, np.uint64)
        for h in part:
            short = mix64(short * np.uint64(0x9E3779B97F4A7C15) + h)
        code, doc = np.append(code, short), np.append(doc, d)
    del found
    if len(offsets) == 2:  # one text, which may be long
        code.sort()
    else:
        order = np.lexsort((code, doc))
        code, doc = code[order], doc[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh], code[fresh]


def take_tokens(doc: np.ndarray, code: np.ndarray, size: np.ndarray, runs: int, similarity: float, step: int = STEP) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level (index into the tokens, run) of those taken. Run and level together have
    one of `slots` equal parts of the ranks' range; a token is taken if its rank falls into the
    beginning of the part, whose share is TAKEN over similarity x size."""
    slots = runs * len(TAKEN)
    taken: list[list] = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] for _ in TAKEN]
    # Sets so small that a share exceeds its part need every part to be looked at.
    small = max(TAKEN) / (similarity * np.maximum(size, 1)) > 1 / slots
    for lo in range(0, len(code), step):
        of, some = doc[lo : lo + step], code[lo : lo + step]
        rank = mix64(some ^ np.uint64(0x5851F42D4C957F2D)).astype(np.float64) / 2.0**64
        own = np.minimum((rank * slots).astype(np.int64), slots - 1)
        share = np.array(TAKEN)[own % len(TAKEN)] / (similarity * size[of])
        hit = np.flatnonzero(~small[of] & (rank - own / slots < share))
        for level in range(len(TAKEN)):
            at = hit[own[hit] % len(TAKEN) == level]
            taken[level].append((at + lo, own[at] // len(TAKEN)))
        few = np.flatnonzero(small[of])
        for slot in range(slots if len(few) else 0):
            run, level = divmod(slot, len(TAKEN))
            at = few[np.mod(rank[few] - slot / slots, 1.0) < TAKEN[level] / (similarity * size[of[few]])]
            taken[level].append((at + lo, np.full(len(at), run)))
    return [tuple(np.concatenate(c) for c in zip(*t)) for t in taken]


def pack_tokens(tokens: np.ndarray) -> bytes:
    """Ascending numbers of BITS bits as their differences, byte by byte: all lowest bytes first. The
    differences of a set of some hundred numbers leave most of the highest bytes zero, which compresses."""
    steps = np.diff(tokens.astype("<u8"), prepend=np.zeros(1, "<u8"))
    return np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T.tobytes()


def unpack_tokens(packed: bytes) -> np.ndarray:
    rows = np.frombuffer(packed, np.uint8).reshape(BITS // 8, -1).T
    steps = np.zeros((len(rows), 8), np.uint8)
    steps[:, : BITS // 8] = rows
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


FIELDS = "entry long, size int, tokens binary, level1 array<struct<run:int,token:long>>, level2 array<struct<run:int,token:long>>, level3 array<struct<run:int,token:long>>, least long"


def table_of_sets(rows: DataFrame, n: int, runs: int, similarity: float) -> DataFrame:
    """One row for each of rows (row, id, text), without the text: the 64-bit fingerprint of its set (entry; null without words),
    its tokens as sorted numbers of BITS bits, and the tokens it takes. Sets that differ have one
    fingerprint in about 1 of 10**19 pairs; two tokens of a pair of sets fall together, which moves
    their similarity by one token, in about 1 of 10**12 pairs of tokens."""
    pair = pa.struct([("run", pa.int32()), ("token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in passes(batch, "text"):
                n_docs = some.num_rows
                doc, code = shingles(*text_buffer(some.column("text")), n)
                size = np.bincount(doc, minlength=n_docs)
                first = np.concatenate([[0], np.cumsum(size)])
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(code), dtype=np.uint64)])
                entry = mix64(sums[first[1:]] - sums[first[:-1]] + size.astype(np.uint64)).view(np.int64)
                low = code >> np.uint64(64 - BITS)
                tokens = [pack_tokens(low[a:b]) for a, b in zip(first[:-1], first[1:])]
                levels = []
                for at, which in take_tokens(doc, code, size, runs, similarity):
                    order = np.argsort(doc[at], kind="stable")
                    at, which = at[order], which[order]
                    ends = np.searchsorted(doc[at], np.arange(n_docs + 1)).astype(np.int32)
                    values = pa.StructArray.from_arrays([pa.array(which.astype(np.int32)), pa.array(code[at].view(np.int64))], fields=list(pair))
                    levels.append(pa.ListArray.from_arrays(pa.array(ends), values))
                least = np.zeros(n_docs, np.int64)
                full = size > 0
                least[full] = np.minimum.reduceat(mix64(code ^ np.uint64(0x2545F4914F6CDD1D)), first[:-1][full]).view(np.int64) if full.any() else 0
                yield pa.RecordBatch.from_arrays(
                    [some.column("row"), some.column("id"), pa.array(entry, mask=~full), pa.array(size.astype(np.int32)), pa.array(tokens, pa.binary()), *levels, pa.array(least)],
                    [f.name for f in schema.fields],
                )

    schema = T.StructType([rows.schema["row"], rows.schema["id"], *T._parse_datatype_string(FIELDS).fields])
    return rows.mapInArrow(run, schema)


def crowded(members: DataFrame) -> DataFrame:
    """Members of buckets with two entries at least, with the number of them."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    return members.join(sizes, "bucket")


def buckets(sets: DataFrame, small: int) -> DataFrame:
    """(bucket, entry) of all buckets to be compared, written. Copies fall together when the taken tokens are
    made distinct, which tasks begin before anything is shuffled."""
    path = lambda before: F.xxhash64(*before, "t.token")
    level = sets.select("entry", F.explode("level1").alias("t")).select("entry", F.col("t.run").alias("run"), path([F.col("t.run")]).alias("bucket")).distinct()
    out, levels = None, []
    for depth, column in enumerate(("level2", "level3", None)):
        level = materialize(crowded(level))
        levels.append(level)
        done = level if column is None else level.where(F.col("many") <= small)
        done = done.select("bucket", "entry")
        out = done if out is None else out.unionByName(done)
        if column:
            large = level.where(F.col("many") > small)
            alike = large.join(sets.select("entry", "least").distinct(), "entry").groupBy("bucket", "least").agg(F.count("*").alias("n"), F.max("many").alias("many"))
            dense = alike.where(F.col("n") >= DENSE * F.col("many")).select("bucket").distinct()
            out = out.unionByName(large.join(dense, "bucket", "left_semi").select("bucket", "entry"))
            open_ = large.join(dense, "bucket", "left_anti").select("bucket", "entry", "run")
            taken = sets.join(open_.select("entry").distinct(), "entry", "left_semi").select("entry", F.explode(column).alias("t")).distinct()
            deeper = open_.join(taken.select("entry", F.col("t.run").alias("run"), "t"), ["entry", "run"])
            level = deeper.select("entry", "run", path([F.col("bucket"), F.lit(depth)]).alias("bucket")).distinct()
    out = materialize(out)
    for level in levels:
        release(level)
    return out


def shared(a_sets: list[np.ndarray], b_sets: list[np.ndarray] | None) -> np.ndarray:
    """Tokens that each set of a shares with each of b (or of a)."""
    n, same = len(a_sets), b_sets is None
    sets = a_sets if same else a_sets + b_sets
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    token = np.concatenate(sets) if len(sets) else np.zeros(0, "<u8")
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(token)))
    cols = n if same else len(b_sets)
    count = np.zeros((n, cols), np.float32)
    for d in range(2, RARE):
        at = first[many == d]
        if not len(at):
            continue
        for lo in range(0, len(at), max(1, 2_000_000 // (d * d))):
            group = owner[at[lo : lo + max(1, 2_000_000 // (d * d)), None] + np.arange(d)]
            flat = []
            for x, y in ((group[:, i], group[:, j]) for i in range(d) for j in range(i + 1, d)):  # x < y, as the sort is stable
                if same:
                    flat += [x * cols + y, y * cols + x]
                else:
                    across = (x < n) & (y >= n)
                    flat.append(x[across] * cols + y[across] - n)
            count += np.bincount(np.concatenate(flat), minlength=n * cols).reshape(n, cols).astype(np.float32)
    often = np.flatnonzero(many >= RARE)
    step = 2_048
    for lo in range(0, len(often), step):
        some = often[lo : lo + step]
        place = np.repeat(first[some] - np.concatenate([[0], np.cumsum(many[some])[:-1]]), many[some]) + np.arange(many[some].sum())
        column = np.repeat(np.arange(len(some)), many[some])
        matrix = np.zeros((len(sets), len(some)), np.float32)
        matrix[owner[place], column] = 1
        count += matrix[:n] @ (matrix if same else matrix[n:]).T
    return count


def earlier(a: list[list[int]], b: list[list[int]] | None, group: int) -> np.ndarray | bool:
    """Which pairs are together in a group before this one, too."""
    lists = a if b is None else a + b
    member = np.repeat(np.arange(len(lists)), [len(gs) for gs in lists])
    of = np.fromiter((g for gs in lists for g in gs), np.int64, len(member))
    member, of = member[of < group], of[of < group]
    _, column, many = np.unique(of, return_inverse=True, return_counts=True)
    common = many >= 2
    member, column = member[common[column]], (np.cumsum(common) - 1)[column[common[column]]]
    if not len(member):
        return False
    out = np.zeros((len(a), len(lists) if b is None else len(b)), bool)
    for lo in range(0, int(column.max()) + 1, 2_048):
        here = (column >= lo) & (column < lo + 2_048)
        matrix = np.zeros((len(lists), 2_048), np.float32)
        matrix[member[here], column[here] - lo] = 1
        out |= matrix[: len(a)] @ (matrix if b is None else matrix[len(a) :]).T > 0
    return out


def components(linked: np.ndarray, n: int, same: bool) -> np.ndarray:
    """Smallest member of each member's component; members are the rows, then the columns unless both are the same."""
    if same:
        label = np.arange(n)
        while True:
            near = np.where(linked, label[None, :], n).min(1) if n else label
            new = np.minimum(label, near)
            new = np.minimum(new, new[new])
            if (new == label).all():
                return label
            label = new
    m = linked.shape[1]
    rows, cols = np.arange(n), n + np.arange(m)
    while True:
        new_cols = np.minimum(cols, np.where(linked, rows[:, None], n + m).min(0, initial=n + m))
        new_rows = np.minimum(rows, np.where(linked, new_cols[None, :], n + m).min(1, initial=n + m))
        if (new_cols == cols).all() and (new_rows == rows).all():
            return np.concatenate([rows, cols])
        rows, cols = new_rows, new_cols


def compare(similarity: float):
    """Brute force over a block of a group, or the pairs between two blocks."""

    def run(key: tuple, members: pa.Table) -> pa.Table:
        group, i, j = (k.as_py() for k in key)
        members = members.sort_by("entry")  # the rest of a group's memory: two blocks' tokens, and one number for each of their pairs
        block = members.column("block").to_numpy()
        parts = [np.flatnonzero(block == i)] if i == j else [np.flatnonzero(block == b) for b in (i, j)]
        entry, copies = members.column("entry").to_numpy(), members.column("copies").to_numpy()
        tokens, groups = members.column("tokens").to_pylist(), members.column("groups").to_pylist()
        sets = [[unpack_tokens(tokens[k]) for k in p] for p in parts]
        size = [np.array([len(s) for s in part], np.float64) for part in sets]
        lists = [[groups[k] for k in p] for p in parts]
        a, b = parts[0], parts[-1]
        count = shared(sets[0], None if i == j else sets[1])
        linked = count >= similarity * (size[0][:, None] + size[-1][None, :] - count) - 1e-9
        if i == j:
            np.fill_diagonal(linked, False)
        root = components(linked, len(a), i == j)
        mine = linked & ~earlier(lists[0], None if i == j else lists[1], group)
        order = a if i == j else np.concatenate([a, b])
        links = mine @ copies[b] if i == j else np.concatenate([mine @ copies[b], copies[a] @ mine])
        at = np.flatnonzero((links > 0) | (root != np.arange(len(order))))
        return pa.table({"entry": entry[order[at]], "links": links[at].astype(np.int64), "root": entry[order[root[at]]]})

    return run


def star(similarity: float):
    """Links within a block of a group, and to the group's representative, which is with each block."""

    def run(key: tuple, members: pa.Table) -> pa.Table:
        group = key[0].as_py()
        members = members.sort_by("entry")
        entry = members.column("entry").to_numpy()
        sets = [unpack_tokens(t) for t in members.column("tokens").to_pylist()]
        size = np.array([len(x) for x in sets], np.float64)
        count = shared(sets, None)
        linked = count >= similarity * (size[:, None] + size[None, :] - count) - 1e-9
        np.fill_diagonal(linked, False)
        root = components(linked, len(entry), True)
        away = root != root[np.flatnonzero(entry == group)[0]]
        return pa.table({"entry": entry, "root": entry[root], "group": np.full(len(entry), group), "away": away})

    return run


def across(similarity: float):
    """Links of guests to the members of a block of their group."""

    def run(key: tuple, members: pa.Table) -> pa.Table:
        members = members.sort_by("entry")
        guest = members.column("guest").to_numpy(zero_copy_only=False)
        entry, tokens = members.column("entry").to_numpy(), members.column("tokens").to_pylist()
        order = np.concatenate([np.flatnonzero(guest), np.flatnonzero(~guest)])
        sets = [unpack_tokens(tokens[k]) for k in order]
        n = int(guest.sum())
        size = np.array([len(x) for x in sets], np.float64)
        if not 0 < n < len(sets):
            return pa.table({"entry": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        count = shared(sets[:n], sets[n:])
        root = components(count >= similarity * (size[:n, None] + size[None, n:] - count) - 1e-9, n, False)
        return pa.table({"entry": entry[order], "root": entry[order[root]]})

    return run


def with_tokens(ids: DataFrame, sets: DataFrame, few: bool = False) -> DataFrame:
    """(places.*, entry, copies, groups, tokens) for ids (row, copies, groups, place): places are given to
    rows as arrays first, so that each set's tokens meet them once and are moved once more, to its places.
    Unless ids are few both sides grow with the documents: a sort-merge join at every size."""
    held = ids.groupBy("row").agg(F.first("copies").alias("copies"), F.first("groups").alias("groups"), F.collect_list("place").alias("places"))
    held = held if few else held.hint("merge")
    return held.join(sets.select("row", "entry", "tokens"), "row").select("entry", "copies", "groups", F.explode("places").alias("p"), "tokens").select("p.*", "entry", "copies", "groups", "tokens")


def spanning_links(placed: DataFrame, sets: DataFrame, similarity: float) -> list[DataFrame]:
    """(entry, root) tables, written, whose components are those of all links within groups.

    placed: row, copies, groups, place (group, block, blocks). Each block of a group is compared in itself
    and with the group's representative. Only entries that this leaves apart from the representative
    go on to the other blocks, so a group of near copies costs its size, not the square of it."""
    fields = "entry long, root long, group long, away boolean"
    # The rows of large groups are written, without tokens, so that Spark knows how few they are.
    some = materialize(placed.where("place.blocks > 1"))
    large = materialize(with_tokens(some, sets, few=True).drop("copies", "groups"))
    lead = large.where(F.col("entry") == F.col("group"))
    sent = lead.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to != block").select("group", F.col("to").alias("block"), "entry", "tokens")
    small = with_tokens(placed.where("place.blocks = 1"), sets).select("group", "block", "entry", "tokens")
    every = small.unionByName(large.select("group", "block", "entry", "tokens")).unionByName(sent)
    near = materialize(every.groupBy("group", "block").applyInArrow(star(similarity), fields).where("root != entry or away"))
    left = large.join(near.where("away").select("group", "entry").distinct(), ["group", "entry"], "left_semi")
    chunks = left.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("chunks"))
    guests = (
        left.join(chunks, "group").withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "entry"), F.col("chunks")).cast("int"))
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to != block")
        .select("group", F.col("to").alias("block"), "chunk", "entry", "tokens", F.lit(True).alias("guest"))
    )
    hosts = large.join(chunks, "group").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("group", "block", "chunk", "entry", "tokens", F.lit(False).alias("guest"))
    far = materialize(guests.unionByName(hosts).groupBy("group", "block", "chunk").applyInArrow(across(similarity), "entry long, root long").where("root != entry"))
    release(some)
    release(large)
    return [near, far]


def connect(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node with an edge (u, v).

    Large-star and small-star rounds: in turn, each node hands its larger neighbours, and its
    smaller ones, to the smallest; stars are left when nothing changes."""
    edges, before = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), None
    while True:
        edges = materialize(edges)
        if before is not None:
            release(before)
        before = edges
        # done when every node has one edge, to a node that has none
        tops = edges.groupBy("u").agg(F.count("*").alias("n"))
        if edges.join(tops.select(F.col("u").alias("w"), "n"), F.col("v") == F.col("w"), "left_semi").isEmpty() and tops.where("n > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def near_duplicates(
    rows: DataFrame, n: int = N, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL, small: int = SMALL, count_links: bool = True,
) -> DataFrame:
    """row, id, class_row, n_links for each of rows (row, id, text); row holds distinct longs.

    Rows whose sets of n-word shingles have a Jaccard similarity of at least `similarity` are
    linked, rows with equal sets always; n_links counts the rows linked to a row (null without
    count_links, which saves most of the work on large groups of near copies), and class_row is
    the smallest row of its component. A text of fewer than n words is one shingle. Null texts
    and texts without words have no links and are classes of their own.
    """
    if similarity <= 0.5:
        raise ValueError("paths are chosen for similarities above a half")
    sets = materialize(table_of_sets(rows, n, runs_for(target_recall), similarity))
    some = sets.where(F.col("entry").isNotNull())
    entries = materialize(some.groupBy("entry").agg(F.min("row").alias("row"), F.count("*").alias("copies")))
    members = buckets(some, small)
    named = members.groupBy("bucket").agg(F.min("entry").alias("group"))
    groups = materialize(members.join(named, "bucket").select("group", "entry").distinct())
    release(members)
    sizes = (
        groups.join(some.select("row", "size").join(entries, "row").select("entry", "size"), "entry")
        .groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    )
    mine = groups.groupBy("entry").agg(F.sort_array(F.collect_list("group")).alias("groups")).join(entries, "entry") if count_links else entries.withColumn("groups", F.lit(None))
    at = groups.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).join(mine, "entry")
    if count_links:
        other = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        place = F.struct("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
        pairs = with_tokens(other.select("row", "copies", "groups", place.alias("place")), sets)
        parts = [materialize(pairs.groupBy("group", "i", "j").applyInArrow(compare(similarity), "entry long, links long, root long"))]
        links = parts[0].groupBy("entry").agg(F.sum("links").alias("links"))
    else:
        placed = materialize(at.select("row", "copies", "groups", F.struct("group", "block", "blocks").alias("place")).drop("copies", "groups"))
        parts = spanning_links(placed.withColumns({"copies": F.lit(None), "groups": F.lit(None)}), sets, similarity)
        release(placed)
        links = entries.select("entry", F.lit(None).cast("long").alias("links"))
    edges = reduce(DataFrame.unionByName, [p.where("root != entry").select(F.col("entry").alias("u"), F.col("root").alias("v")) for p in parts])
    roots = connect(edges)
    known = (
        entries.select("entry", "row", "copies").join(links, "entry", "left").join(roots, F.col("entry") == F.col("node"), "left")
        .select("entry", "row", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "entry").alias("root"))
    )
    classes = known.groupBy("root").agg(F.min("row").alias("class_row"))
    result = materialize(known.join(classes, "root").select("entry", "class_row", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    # Rows without an entry meet nothing; the salt keeps them from one task.
    own = sets.select("row", "id", "entry", F.when(F.col("entry").isNull(), F.col("row") % 4096).otherwise(0).alias("salt"))
    n_links = F.coalesce("n_links", F.lit(0)).cast("long") if count_links else F.lit(None).cast("long")
    found_rows = materialize(own.join(result.withColumn("salt", F.lit(0).cast("long")), ["entry", "salt"], "left").select("row", "id", F.coalesce("class_row", "row").alias("class_row"), n_links.alias("n_links")))
    for done in (sets, entries, groups, *parts, roots, result):  # their rows are in the result now
        release(done)
    return found_rows


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, class_id, n_links for each row of docs. class_id is the smallest id among the class,
    null if none has one. Null and repeated ids are kept; repeated rows are copies, linked like any
    others. Other columns are not read. An empty table gives an empty result."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = near_duplicates(rows, **options)
    least = found.groupBy("class_row").agg(F.min("id").alias("class_id"))
    return found.join(least, "class_row").select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of near duplicates, with all its columns: the one with the smallest id, nulls last."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc")  # so that no column of docs meets a name used here
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), whole))  # written, so that the numbers hold
    rows = numbered.select("row", F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("text"))
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"))
    keep = near_duplicates(rows, count_links=False, **options).groupBy("class_row").agg(F.min(order).alias("first")).select(F.col("first.c").alias("row"))
    # Both sides grow with the documents: a sort-merge join at every size, so that what is moved grows alike.
    return numbered.join(keep.hint("merge"), "row", "left_semi").select("doc.*")
