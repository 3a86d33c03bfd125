"""Paths, subsumers and depths in the is-a taxonomy.

A path is an array from a concept up to a root; with a root node it ends in the virtual
root. Candidates for the lowest common subsumer of two concepts are, for each pair of
their paths, the first node of the second path that is on the first: other common
ancestors are no candidates, which matters where depth or information picks among them.

Where no links run in a circle, candidates are known without pairs of paths. Two paths from the
concepts that meet at x only are two ways without a node in common, and there are none exactly if
all ways from both concepts to x pass one other node. So a concept is packed as its ancestors, each
with its least distance and the last node before it that all ways pass; common ancestors are candidates
unless these nodes are the same, and the work of a pair grows with its ancestors, not with its paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from relspark.functions.text import pad_id
from relspark.lexicon import ROOT, delete, materialize
from relspark.operators.joins import join_spread


def parents_of(isa: DataFrame) -> DataFrame:
    """(pos, child, parents): one row for each concept that has parents."""
    return isa.groupBy("pos", "child").agg(F.sort_array(F.collect_set("parent")).alias("parents"))


def root_paths(isa: DataFrame, members: DataFrame, root_node: bool = True, height: int | None = None) -> DataFrame:
    """(pos, id, path): every path from each member (pos, id) to a root, bottom-up.

    A path never meets a node twice. Where all parents of a node are on the path already, the
    node counts as a root. With the taxonomy's height the whole is one plan over the paths of members. Without it, pieces
    of paths are joined with pieces that go on where they end, so that each round doubles their length: a
    taxonomy of any height takes as many rounds as its height has binary digits. Only where links run in a circle do paths grow by one node a round;
    a further column `circular` then says so. A taxonomy whose height is given has no circles.
    """
    own = members.select("pos", "id").distinct()
    found = grown_paths(isa, own, height) if height is not None else doubled_paths(isa, own)
    circles = found is None
    if circles:
        found = grown_paths(isa, own, None)
    path = F.concat("path", F.array(F.lit(ROOT).cast("long"))) if root_node else F.col("path")
    return found.select("pos", "id", path.alias("path"), *([F.lit(True).alias("circular")] if circles else []))


def grown_paths(isa: DataFrame, members: DataFrame, height: int | None) -> DataFrame:
    """(pos, id, path) of members, a node a round; without a height each round is written, and the loop ends when no path grows."""
    up = parents_of(isa).withColumnRenamed("pos", "_pos")
    paths = members.select("pos", "id", F.array("id").alias("path"), F.lit(False).alias("done"))
    level = 0
    while height is None or level < height:
        # Ended paths meet no parents; their key is a number that no concept has, one for each.
        at = F.when(F.col("done"), -1 - F.col("id")).otherwise(F.element_at("path", -1))
        step = paths.withColumn("_at", at).join(up, (F.col("pos") == F.col("_pos")) & (F.col("_at") == F.col("child")), "left")
        fresh = F.filter("parents", lambda p: ~F.array_contains(F.col("path"), p))
        grown = step.select("pos", "id", "path", F.explode_outer(fresh).alias("next"))
        paths = grown.select(
            "pos", "id", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path"), F.col("next").isNull().alias("done")
        )
        if height is None:
            paths = materialize(paths)
            if paths.where("not done").isEmpty():
                break
        level += 1
    return paths.select("pos", "id", "path")


def doubled_paths(isa: DataFrame, members: DataFrame) -> DataFrame | None:
    """(pos, id, path) of members by doubling; None if a path meets a node twice."""
    isa = isa.select("pos", "child", "parent").distinct()
    tops = isa.select("pos", F.col("parent").alias("id")).unionByName(members).distinct().join(isa.select("pos", F.col("child").alias("id")), ["pos", "id"], "left_anti")
    top = tops.select("pos", F.col("id").alias("parent"), F.lit(True).alias("done"))
    links = isa.join(top, ["pos", "parent"], "left").select("pos", F.col("child").alias("id"), F.array("child", "parent").alias("path"), F.coalesce("done", F.lit(False)).alias("done"))
    pieces = materialize(links.unionByName(tops.select("pos", "id", F.array("id").alias("path"), F.lit(True).alias("done"))))
    key = lambda pos, id_: F.concat_ws(":", pos, id_.cast("string")).alias("_key")
    while not pieces.where("not done").isEmpty():
        ahead = pieces.groupBy(key(F.col("pos"), F.col("id"))).agg(F.collect_list(F.struct("path", "done")).alias("ahead"))  # as many as a concept has pieces
        open_ = pieces.where("not done").withColumn("_key", key(F.col("pos"), F.element_at("path", -1)))
        longer = join_spread(open_, ahead, "_key").select("pos", "id", "path", F.explode("ahead").alias("a"))
        joined = longer.select("pos", "id", F.concat(F.slice("path", F.lit(1), F.size("path") - 1), "a.path").alias("path"), F.col("a.done").alias("done"))
        before, pieces = pieces, materialize(pieces.where("done").unionByName(joined))
        delete(before)
        if not pieces.where(F.size(F.array_distinct("path")) < F.size("path")).isEmpty():
            return None
    return pieces.join(members, ["pos", "id"], "left_semi").select("pos", "id", "path")


def concept_key() -> Column:
    return F.concat_ws(":", "pos", F.col("id").cast("string"))


def kinds(isa: DataFrame, members: DataFrame) -> DataFrame:
    """(pos, id, kind, twin) of members: those without children and with the same parents are of one kind, named by the least
    of them; twin is the greatest. All others are each a kind of its own. What is above two different concepts of a kind is the same."""
    own = members.select("pos", "id").distinct()
    above = F.array_join(F.transform("parents", lambda p: p.cast("string")), ",")
    leaves = own.join(isa.select("pos", F.col("parent").alias("id")), ["pos", "id"], "left_anti")
    found = leaves.join(parents_of(isa).withColumnRenamed("child", "id"), ["pos", "id"]).select("pos", "id", F.concat_ws(":", "pos", above).alias("_above"))
    found = materialize(found)
    ends = found.groupBy("_above").agg(F.min("id").alias("kind"), F.max("id").alias("twin"))
    of = join_spread(found, ends, "_above").drop("_above")
    rest = own.join(found, ["pos", "id"], "left_anti").select("pos", "id", F.col("id").alias("kind"), F.col("id").alias("twin"))
    return of.unionByName(rest)


def ways_of(paths: DataFrame) -> DataFrame:
    """(pos, id, ways): all paths of a concept in one row. A concept of k paths is an array of k,
    whatever the number of its pairs."""
    return paths.groupBy("pos", "id").agg(F.collect_list("path").alias("ways"))


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the lists, the list of each value, the values. A null is an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def gates(group: np.ndarray, before: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For each group (a node above one concept) the last group that all ways from the concept to it pass; -1
    for the concept itself. group, before: the links of the ways; far: nodes on the longest way to each group.
    Where ways meet, both sides go back to where they part, in the order of far, so that what they pass is known."""
    gate = np.full(len(far), -1)
    linked = np.unique(np.stack([group, before], 1)[before >= 0], axis=0)
    starts = np.flatnonzero(np.r_[True, linked[1:, 0] != linked[:-1, 0]]) if len(linked) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(linked)]
    one = ends - starts == 1
    gate[linked[starts[one], 0]] = linked[starts[one], 1]
    many = np.flatnonzero(~one)
    for at in many[np.argsort(far[linked[starts[many], 0]], kind="stable")]:
        u, *others = linked[starts[at] : ends[at], 1].tolist()
        for v in others:
            while u != v:
                if far[u] > far[v]:
                    u = gate[u]
                else:
                    v = gate[v]
        gate[linked[starts[at], 0]] = u
    return gate


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ways of each concept as its ancestors, itself included: node, least number of nodes to it, place of its gate among them (-1: none);
    and its own depth and root, the least of what is left of all ways from it on, as all its ways are among them. Where ways bring
    `freqs`, a number for each of their nodes, also these."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ways = batch.column("ways")
        _, way_row, _ = flat(ways)
        sizes, way, node = flat(ways.flatten())
        place = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        row = way_row[way]
        left, top = np.repeat(sizes, sizes) - place + 1, np.repeat(node[np.cumsum(sizes) - 1], sizes)
        order = np.lexsort((top, left, node, row))
        fresh = np.r_[True, (row[order][1:] != row[order][:-1]) | (node[order][1:] != node[order][:-1])]
        group, starts = np.empty(len(node), np.int64), np.flatnonzero(fresh)
        group[order] = np.cumsum(fresh) - 1
        near, far = (f.reduceat(place[order], starts) for f in (np.minimum, np.maximum))
        before = np.where(place > 1, np.r_[-1, group[:-1]], -1)
        gate, own = gates(group, before, far), node[order][starts]
        offsets = pa.array(np.searchsorted(row[order][starts], np.arange(batch.num_rows + 1)).astype(np.int32))
        first = np.repeat(offsets.to_numpy()[:-1], np.diff(offsets.to_numpy()))
        values, names = [own, near.astype(np.int32), np.where(gate >= 0, gate - first, -1).astype(np.int32)], ["nodes", "near", "gates"]
        if "freqs" in batch.schema.names:
            values, names = [*values, batch.column("freqs").flatten().flatten().to_numpy(zero_copy_only=False)[order][starts]], [*names, "freqs"]
        else:
            values, names = [*values, left[order][starts].astype(np.int32), top[order][starts]], [*names, "depths", "roots"]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in values]
        yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("id"), *lists], ["pos", "id", *names])


def meet(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """row and node of all ancestors of both concepts of each pair, a's before b's, of which there are so many; and where the candidates
    of pairs stand among a's and b's."""
    sides = []
    for side in "ab":
        sizes, row, node = flat(batch.column(f"nodes_{side}"))
        place = flat(batch.column(f"gates_{side}"))[2]
        gate = np.where(place >= 0, node[place + (np.cumsum(sizes) - sizes)[row]], -1) if len(node) else node
        sides.append((row, node, gate))
    row, node, gate = (np.concatenate(x) for x in zip(*sides))
    order = np.lexsort((node, row))  # stable: the first concept's node stands before the second's
    i, j = order[:-1], order[1:]
    met = (row[i] == row[j]) & (node[i] == node[j]) & ((gate[i] != gate[j]) | (gate[i] < 0))
    return row, node, i[met], j[met], len(sides[0][0])


#: What `pack` makes of ways without and with frequencies.
PACKED = "pos string, id long, nodes array<long>, near array<int>, gates array<int>, depths array<int>, roots array<long>"
COUNTED = "pos string, id long, nodes array<long>, near array<int>, gates array<int>, freqs array<double>"


def joint(pick: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """pos, a, b, subsumer, la, lb: the candidates of each pair; or those on its shortest ways, or one of these; or its deepest, with depth and root."""
        for batch in batches:
            row, node, i, j, _ = meet(batch)
            near = np.concatenate([flat(batch.column(f"near_{side}"))[2] for side in "ab"])
            more = []
            if pick == "deepest":
                depth, root = (flat(batch.column(f"{c}_a"))[2] for c in ("depths", "roots"))
                most = np.zeros(batch.num_rows, np.int32)
                np.maximum.at(most, row[i], depth[i])  # i is on the first concept's side
                on = depth[i] == most[row[i]]
                i, j = i[on], j[on]
                more = [pa.array(x[i]) for x in (depth, root)]
            elif pick:
                least = np.full(batch.num_rows, np.iinfo(np.int32).max)
                np.minimum.at(least, row[i], near[i] + near[j])
                on = near[i] + near[j] == least[row[i]]
                i, j = i[on], j[on]
                if pick == "one":
                    first = np.unique(row[i], return_index=True)[1]
                    i, j = i[first], j[first]
            at = pa.array(row[i])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("pos", "a", "b")), pa.array(node[i]), pa.array(near[i]), pa.array(near[j]), *more],
                ["pos", "a", "b", "subsumer", "la", "lb", *(("depth", "root") if more else ())],
            )

    return run


def joint_nodes(pairs: DataFrame, paths: DataFrame, pick: str = "") -> DataFrame:
    """pos, a, b, subsumer, la, lb: the candidates of each of pairs (pos, a, b), with the
    nodes on the shortest ways from a and from b to them. pick: `shortest`, those on shortest ways; `one`, one of these; `deepest`, those of
    the largest depth (the smallest of each), with depth and root. It is done in the pair's row, as nearly all pairs have few nodes
    near the top for subsumers, which as keys of a join would be hot. A pair of one concept has itself alone. Paths must have no
    circles; ids are not negative. A pair stays in its row: only the two joins shuffle."""
    packed = ways_of(paths).mapInArrow(pack, PACKED)
    side = lambda s, *more: packed.select("pos", F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("nodes", "near", "gates", *more)))
    both = pairs.select("pos", "a", "b").join(side("a", *(("depths", "roots") if pick == "deepest" else ())), ["pos", "a"]).join(side("b"), ["pos", "b"])
    return both.mapInArrow(joint(pick), "pos string, a long, b long, subsumer long, la int, lb int" + (", depth int, root long" if pick == "deepest" else ""))


def in_rows(rows: DataFrame, packed: DataFrame, kept: tuple[str, ...], kept_b: tuple[str, ...] = (), own: bool = False) -> DataFrame:
    """rows (pos_a, a, pos_b, b, ..) with the packed columns kept of both concepts, and kept_b of the second, which no row brings through a
    shuffle. Rows need not be distinct; none is lost. With own also freq_a, freq_b, the concepts' own."""
    freq = lambda s: F.element_at("freqs", F.array_position("nodes", F.col("id")).cast("int")).alias(f"freq_{s}")
    side = lambda s, columns: packed.select(F.col("pos").alias(f"pos_{s}"), F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns), *([freq(s)] if own else []))
    return rows.join(side("a", kept), ["pos_a", "a"], "left").join(side("b", (*kept, *kept_b)), ["pos_b", "b"], "left")


def passed(batch: pa.RecordBatch, columns: list[str], at: pa.Array | None = None) -> list[pa.Array]:
    return [batch.column(c) if at is None else batch.column(c).take(at) for c in columns]


def lengths_in_row(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """rows (pos_a, a, pos_b, b, ..) with len, the nodes on the shortest way, or null. Paths must have no circles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, i, j, _ = meet(batch)
            near = np.concatenate([flat(batch.column(f"near_{side}"))[2] for side in "ab"])
            none = np.iinfo(np.int32).max
            least = np.full(batch.num_rows, none, np.int32)
            np.minimum.at(least, row[i], near[i] + near[j] - 1)
            yield pa.RecordBatch.from_arrays([*passed(batch, columns), pa.array(least, mask=least == none)], [*columns, "len"])

    columns = rows.columns
    packed = materialize(ways_of(paths).mapInArrow(pack, PACKED).select("pos", "id", "nodes", "near", "gates"))
    return in_rows(rows, packed, ("nodes", "near", "gates")).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("len", T.IntegerType())]))


def counted_ways(isa: DataFrame, members: DataFrame, counts: DataFrame, height: int, root_node: bool = True) -> DataFrame:
    """(pos, id, ways, freqs): the paths that `root_paths` gives for a taxonomy of known height, those of a concept in one row, and the frequency of each
    of their nodes: 0 where none is known, and at the virtual root. counts: pos, id, freq. Only paths of concepts with children grow step by
    step; they then meet all links to these concepts, and those of one concept its row."""
    isa, freq = isa.select("pos", "child", "parent"), counts.select("pos", "id", F.col("freq").cast("double").alias("freq"))
    key = lambda c: F.struct("pos", F.col(c).alias("id")).alias("_key")
    counted = lambda rows: rows.join(freq, ["pos", "id"], "left").withColumn("freq", F.coalesce("freq", F.lit(0.0)))
    above = materialize(counted(isa.select("pos", F.col("parent").alias("id")).distinct()))
    inner = isa.join(above.select("pos", F.col("id").alias("child")), ["pos", "child"], "left_semi")
    links = join_spread(materialize(inner.select("pos", "child", "parent", key("parent"))), above.select(key("id"), "freq"), "_key")
    up = links.groupBy(F.col("pos").alias("_pos"), "child").agg(F.collect_set(F.struct("parent", "freq")).alias("parents"))
    paths = above.select("pos", "id", F.array("id").alias("path"), F.array("freq").alias("freqs"), F.lit(False).alias("done"))
    for _ in range(height - 1):
        # Ended paths meet no parents; their key is a number that no concept has, one for each.
        at = F.when(F.col("done"), -1 - F.col("id")).otherwise(F.element_at("path", -1))
        step = paths.withColumn("_at", at).join(up, (F.col("pos") == F.col("_pos")) & (F.col("_at") == F.col("child")), "left")
        grown, last = step.select("pos", "id", "path", "freqs", F.explode_outer("parents").alias("next")), F.col("next").isNull()
        more = lambda c, value, last=last: F.when(last, F.col(c)).otherwise(F.concat(c, F.array(value))).alias(c)
        paths = grown.select("pos", "id", more("path", "next.parent"), more("freqs", "next.freq"), last.alias("done"))
    ways = materialize(paths.groupBy("pos", "id").agg(F.collect_list(F.struct("path", "freqs")).alias("w")))
    met = join_spread(isa.distinct().withColumn("_key", key("parent")), ways.select(key("id"), "w"), "_key")
    of = met.groupBy("pos", F.col("child").alias("id")).agg(F.flatten(F.collect_list("w")).alias("w"))
    found = counted(members.select("pos", "id").distinct()).join(of, ["pos", "id"], "left")
    nothing = F.array(F.struct(F.array().cast("array<long>").alias("path"), F.array().cast("array<double>").alias("freqs")))
    whole = lambda c, first, last: F.transform(F.coalesce("w", nothing), lambda x: F.concat(F.array(first), x[c], *([F.array(last)] if root_node else [])))
    return found.select("pos", "id", whole("path", F.col("id"), F.lit(ROOT).cast("long")).alias("ways"), whole("freqs", F.col("freq"), F.lit(0.0)).alias("freqs"))


def informed_in_row(rows: DataFrame, ways: DataFrame, root_freq: DataFrame, ties: bool = False) -> DataFrame:
    """rows (pos_a, a, pos_b, b, ..) with freq_a, freq_b, root_freq, subsumer and freq_l, of the candidate of most information (the smallest of
    several); null where there is none. With ties all of them, and no row where there is none. ways: as `counted_ways` has them;
    root_freq: pos, root_freq. It is done in the pair's row: only the two joins shuffle, and the first concept's side brings no frequencies but its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, node, i, j, n_a = meet(batch)
            root = np.nan_to_num(batch.column("root_freq").to_numpy(zero_copy_only=False).astype(float))[row[i]]
            freq = np.where(node[i] == ROOT, root, flat(batch.column("freqs_b"))[2][j - n_a])
            share = np.divide(freq, root, out=np.zeros(len(freq)), where=root > 0)
            known = (share > 0) & (share <= 1)
            ic = np.where(known, -np.log(np.where(known, share, 1.0)), 0.0)
            order = np.lexsort((node[i], -ic, row[i]))
            _, first, of = np.unique(row[i][order], return_index=True, return_inverse=True)
            on = order[ic[order] == ic[order][first][of]] if ties else order[first]
            if ties:
                at, subsumer, found = pa.array(row[i][on]), pa.array(node[i][on]), pa.array(freq[on])
            else:
                met = np.full(batch.num_rows, -1)
                met[row[i][on]] = on
                at, none = None, met < 0
                subsumer, found = (pa.array(x[met] if len(x) else np.zeros(len(met), x.dtype), mask=none) for x in (node[i], freq))
            yield pa.RecordBatch.from_arrays([*passed(batch, columns, at), subsumer, found], [*columns, "subsumer", "freq_l"])

    packed = materialize(ways.mapInArrow(pack, COUNTED).select("pos", "id", "nodes", "gates", "freqs"))
    columns = [*rows.columns, "freq_a", "freq_b", "root_freq"]
    both = in_rows(rows, packed, ("nodes", "gates"), ("freqs",), True)
    whole = both.join(F.broadcast(root_freq.select(F.col("pos").alias("pos_a"), "root_freq")), "pos_a", "left")  # a row for each part of speech
    fields = [*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns[-3:]), T.StructField("subsumer", T.LongType()), T.StructField("freq_l", T.DoubleType())]
    return whole.mapInArrow(run, T.StructType(fields))


def circular(paths: DataFrame) -> bool:
    """Whether paths, as `root_paths` made them, are of a taxonomy with circles."""
    return "circular" in paths.columns


def meetings(pairs: DataFrame, paths: DataFrame, nodes: bool = False) -> DataFrame:
    """pos, a, b, met: for each of pairs (pos, a, b) that meets, the distinct (subsumer, len) of its
    pairs of paths: the candidate, and the nodes on the way, both ends included. With nodes also
    the way itself, one for each pair of paths. Each pair stays one row, so nothing is shuffled but
    for the two joins."""

    def at(p: Column, q: Column, x: Column) -> Column:
        i, j = F.array_position(p, x).cast("int"), F.array_position(q, x).cast("int")
        way = [F.concat(F.slice(p, F.lit(1), i), F.reverse(F.slice(q, F.lit(1), j - 1))).alias("nodes")] if nodes else []
        return F.struct(x.alias("subsumer"), (i + j - 1).alias("len"), *way)

    def first(p: Column, q: Column) -> Column:
        common = F.filter(q, lambda x: F.array_contains(p, x))
        return F.transform(F.slice(common, 1, 1), lambda x: at(p, q, x))

    ways = ways_of(paths)
    left = ways.select("pos", F.col("id").alias("a"), F.col("ways").alias("_up"))
    right = ways.select("pos", F.col("id").alias("b"), F.col("ways").alias("_down"))
    both = pairs.select("pos", "a", "b").join(left, ["pos", "a"]).join(right, ["pos", "b"])
    met = F.flatten(F.transform("_up", lambda p: F.flatten(F.transform("_down", lambda q: first(p, q)))))
    return both.select("pos", "a", "b", (met if nodes else F.array_distinct(met)).alias("met")).where(F.size("met") > 0)


def shortest(met: Column) -> Column:
    """Nodes on the shortest way of a pair that meets."""
    return F.array_min(F.transform(met, lambda m: m["len"]))


def highest(rows: DataFrame, by: str, *also: str) -> DataFrame:
    """pos, a, b, subsumer, by, also: the distinct rows of each pair of the largest `by`, ties included.
    The groups are the candidates of one pair, so they are small."""
    sets = rows.groupBy("pos", "a", "b").agg(F.collect_set(F.struct(by, "subsumer", *also)).alias("_s"), F.max(by).alias("_top"))
    top = F.filter("_s", lambda r: r[by] == F.col("_top"))
    return sets.select("pos", "a", "b", F.explode(top).alias("_m")).select("pos", "a", "b", "_m.subsumer", f"_m.{by}", *(f"_m.{c}" for c in also))


def candidates(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """pos, a, b, subsumer: the candidates of each pair, once each."""
    if not circular(paths):
        return joint_nodes(pairs, paths).select("pos", "a", "b", "subsumer")
    met = meetings(pairs, paths)
    once = F.array_distinct(F.transform("met", lambda m: m["subsumer"]))
    return met.select("pos", "a", "b", F.explode(once).alias("subsumer"))


#: Pairs of paths that are compared at once, but for those of one pair.
PATH_PAIRS = 1 << 18


def all_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos, a, b, subsumer, len, nodes for each pair of paths of `_up` and `_down` that meets: up the first to the first node of the second that is on
    it, and down the second. Nodes of one pair meet by sorting, so the work grows with the nodes on paths and with the nodes that two paths share."""
    for batch in batches:
        n_pairs = np.cumsum(np.prod([flat(batch.column(c))[0] for c in ("_up", "_down")], axis=0))
        cuts = np.flatnonzero(np.diff(n_pairs // PATH_PAIRS)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if end > start:
                yield ways_between(batch.slice(start, end - start))


def ways_between(batch: pa.RecordBatch) -> pa.RecordBatch:
    sides = []
    for side in ("_up", "_down"):
        ways = batch.column(side)
        _, way_row, _ = flat(ways)
        sizes, way, node = flat(ways.flatten())
        first = np.cumsum(sizes) - sizes
        sides.append((way_row[way], way, node, np.arange(len(node)) - first[way], first))
    (row_p, way_p, node_p, at_p, first_p), (row_q, way_q, node_q, at_q, first_q) = sides
    names, code = np.unique(np.concatenate([node_p, node_q]), return_inverse=True)
    key_p, key_q = row_p * len(names) + code[: len(node_p)], row_q * len(names) + code[len(node_p) :]
    order = np.argsort(key_q, kind="stable")
    low, high = (np.searchsorted(key_q[order], key_p, side=s) for s in ("left", "right"))
    size = high - low
    i = np.repeat(np.arange(len(key_p)), size)
    j = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
    # Of each two paths the first node of the second.
    by = np.lexsort((at_q[j], way_q[j], way_p[i]))
    i, j = i[by], j[by]
    fresh = np.r_[True, (way_p[i][1:] != way_p[i][:-1]) | (way_q[j][1:] != way_q[j][:-1])] if len(i) else np.zeros(0, bool)
    i, j = i[fresh], j[fresh]
    up, down = at_p[i] + 1, at_q[j]
    whole, of = up + down, np.repeat(np.arange(len(i)), up + down)
    ends = np.cumsum(whole)
    place, on_up, nodes = np.arange(len(of)) - (ends - whole)[of], None, np.zeros(len(of), np.int64)
    on_up = place < up[of]
    nodes[on_up] = node_p[(first_p[way_p[i]][of] + place)[on_up]]
    nodes[~on_up] = node_q[(first_q[way_q[j]][of] + whole[of] - 1 - place)[~on_up]]
    at = pa.array(row_p[i])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(nodes))
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("pos", "a", "b")), pa.array(node_p[i]), pa.array(whole.astype(np.int32)), lists], ["pos", "a", "b", "subsumer", "len", "nodes"])


def all_paths(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """pos, a, b, subsumer, len, nodes: every way from a up to a candidate and down to b, for each pair of paths."""
    ways = ways_of(paths)
    side = lambda s, name: ways.select("pos", F.col("id").alias(s), F.col("ways").alias(name))
    both = pairs.select("pos", "a", "b").join(side("a", "_up"), ["pos", "a"]).join(side("b", "_down"), ["pos", "b"]).select("pos", "a", "b", "_up", "_down")
    return both.mapInArrow(all_ways, "pos string, a long, b long, subsumer long, len int, nodes array<long>")


def shortest_paths(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """pos, a, b, len, nodes: the shortest ways, ties included, distinct."""
    met = meetings(pairs, paths, True).withColumn("_min", shortest(F.col("met")))
    ways = F.transform(F.filter("met", lambda m: m["len"] == F.col("_min")), lambda m: m["nodes"])
    return met.select("pos", "a", "b", F.col("_min").alias("len"), F.explode(F.array_distinct(ways)).alias("nodes"))


def path_lengths(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """pos, a, b, len: nodes on the shortest way."""
    if not circular(paths):
        # One row of a pair is enough: subsumers on shortest ways have one length.
        return joint_nodes(pairs, paths, "one").select("pos", "a", "b", (F.col("la") + F.col("lb") - 1).alias("len"))
    return meetings(pairs, paths).select("pos", "a", "b", shortest(F.col("met")).alias("len"))


def lcs_by_path(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """pos, a, b, subsumer, len for the subsumers on shortest ways."""
    if not circular(paths):
        return joint_nodes(pairs, paths, "shortest").select("pos", "a", "b", "subsumer", (F.col("la") + F.col("lb") - 1).alias("len"))
    met = meetings(pairs, paths).withColumn("_min", shortest(F.col("met")))
    return met.select("pos", "a", "b", F.inline(F.filter("met", lambda m: m["len"] == F.col("_min"))))


def deepest(found: DataFrame, depths: DataFrame) -> DataFrame:
    """pos, a, b, subsumer, depth, root for the deepest of candidates (pos, a, b, subsumer), with their other columns."""
    known = depths.select("pos", F.col("id").alias("subsumer"), "depth", "root")
    also = [c for c in found.columns if c not in ("pos", "a", "b", "subsumer")]
    return highest(found.join(known, ["pos", "subsumer"]), "depth", "root", *also)


def lcs_by_depth(pairs: DataFrame, paths: DataFrame, depths: DataFrame) -> DataFrame:
    """pos, a, b, subsumer, depth, root for the deepest candidates. depths: pos, id, depth, root."""
    return deepest(candidates(pairs, paths), depths)


def with_ic(pairs: DataFrame, paths: DataFrame, ic: DataFrame) -> DataFrame:
    """pos, a, b, subsumer, ic of all candidates; 0 where nothing is known. ic: pos, id, ic."""
    known = ic.select("pos", F.col("id").alias("subsumer"), "ic")
    return candidates(pairs, paths).join(known, ["pos", "subsumer"], "left").withColumn("ic", F.coalesce("ic", F.lit(0.0)))


def lcs_by_ic(pairs: DataFrame, paths: DataFrame, ic: DataFrame) -> DataFrame:
    """pos, a, b, subsumer, ic for the candidates of most information. ic: pos, id, ic."""
    return highest(with_ic(pairs, paths, ic), "ic")


def depths_and_roots(paths: DataFrame, root_node: bool = True) -> DataFrame:
    """pos, id, depth, root: each distinct depth of a concept, with the root it is counted from."""
    return paths.select("pos", "id", F.size("path").alias("depth"), F.element_at("path", -1).alias("root")).distinct()


def synset_depth(paths: DataFrame, order: str = "numeric", root_node: bool = True) -> DataFrame:
    """pos, id, depth, root: one depth for each concept.

    numeric: the smallest, ties to the smaller root. lexical: the first of "depth:root" in the
    order of strings, as files of depths list them, where 10 comes before 9.
    """
    if order not in ("numeric", "lexical"):
        raise ValueError(order)
    own = F.element_at("path", -2 if root_node else -1)  # the root below the virtual one
    rows = paths.where(F.size("path") > (1 if root_node else 0)).select("pos", "id", F.size("path").alias("depth"), F.element_at("path", -1).alias("root"), own.alias("_own"))
    written = F.concat((F.col("depth") - (1 if root_node else 0)).cast("string"), F.lit(":"), pad_id(F.col("_own")))
    key = F.struct("depth", "_own") if order == "numeric" else F.struct(written, F.col("_own"))
    return rows.groupBy("pos", "id").agg(F.min_by(F.struct("depth", "root"), key).alias("d")).select("pos", "id", "d.depth", "d.root")


def taxonomies(paths: DataFrame) -> DataFrame:
    """pos, id, root: the distinct roots above each concept."""
    return paths.select("pos", "id", F.element_at("path", -1).alias("root")).distinct()


def top_nodes(lexicon_nodes: DataFrame, isa: DataFrame) -> DataFrame:
    """Concepts (pos, id) without a parent."""
    return lexicon_nodes.select("pos", "id").join(isa.select("pos", F.col("child").alias("id")), ["pos", "id"], "left_anti")


def leaf_nodes(lexicon_nodes: DataFrame, isa: DataFrame) -> DataFrame:
    """Concepts (pos, id) without a child."""
    return lexicon_nodes.select("pos", "id").join(isa.select("pos", F.col("parent").alias("id")), ["pos", "id"], "left_anti")


def virtual_depth(nodes: DataFrame, isa: DataFrame, height: int) -> DataFrame:
    """pos, depth: that of the virtual root as `taxonomy_depths` has it, by least depths, for a taxonomy of known height. Only concepts with children have
    their paths made; a leaf is one deeper than the least of its parents."""
    key = lambda c: F.struct("pos", F.col(c).alias("id")).alias("_key")
    inner = materialize(isa.select("pos", F.col("parent").alias("id")).distinct())
    own = root_paths(isa, inner, False, max(height - 1, 0)).groupBy("pos", "id").agg(F.min(F.size("path")).alias("depth"))
    links = join_spread(isa.select("pos", "child", key("parent")), materialize(own.select(key("id"), "depth")), "_key")
    below = links.groupBy("pos", F.col("child").alias("id")).agg((F.min("depth") + 1).alias("depth"))
    alone = nodes.select("pos", "id").distinct().join(below, ["pos", "id"], "left").withColumn("depth", F.coalesce("depth", F.lit(1)))
    leaves = alone.join(inner, ["pos", "id"], "left_anti")
    return leaves.groupBy("pos").agg((F.max("depth") + 1).alias("depth"))


def taxonomy_depths(nodes: DataFrame, isa: DataFrame, root_node: bool = True, height: int | None = None, order: str = "numeric") -> DataFrame:
    """pos, root, depth: the largest depth of a leaf (by its first depth) below each root; with a
    root node also the virtual root, one deeper than the deepest."""
    leaves = leaf_nodes(nodes, isa)
    own = synset_depth(root_paths(isa, leaves, False, height), order, False)
    below = own.groupBy("pos", "root").agg(F.max("depth").alias("depth"))
    if not root_node:
        return below
    return below.unionByName(below.groupBy("pos").agg((F.max("depth") + 1).alias("depth")).withColumn("root", F.lit(ROOT).cast("long")))
