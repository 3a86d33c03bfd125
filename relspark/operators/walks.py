"""Medium-strong relations: walks of two to five links, upward, horizontal and downward.

The legal walks are U+, U+D+, U+H+, U+H+D+, D+, D+H+, H+ and H+D+. So each is either up, then
along, then down, with any part left out, or down and then along. It is found by meeting:
from the first concept up and along, from the second back along the downward links. No step
goes down from a hub, so a concept with millions below it costs nothing.

A walk scores 8 - links - turns. The turns are those of the walk's last link, not a sum: U to D
or H and U to H to D with one D count 1 and 2; more links of the last kind count 1 each; what
begins with H or D turns for free, but not a second link after the turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from relspark.lexicon import materialize

#: The direction of each relation.
DIRECTIONS = {
    "also": "H", "ants": "H", "attr": "H", "pert": "H", "sim": "H",
    "hype": "U", "mero": "U",
    "holo": "D", "hypo": "D", "enta": "D", "caus": "D",
}
MAX_LINKS, STRONG = 5, 16
KEYS = ["pos_a", "a", "pos_b", "b"]
#: What the ends of a pair reach, in its row.
PACKED = ("nodes_a", "marks_a", "ways_a", "nodes_b", "marks_b", "ways_b")
WAYS = ("ways_a", "ways_b")


def links(edge: DataFrame, sense: DataFrame) -> DataFrame:
    """(dir, src_pos, src, dst_pos, dst): relations with a direction. Of relations between words
    those count whose source is the concept's first word."""
    names = F.create_map(*(F.lit(x) for kv in DIRECTIONS.items() for x in kv))
    first = sense.where("word_no = 1").select(F.col("pos").alias("src_pos"), F.col("id").alias("src"), F.col("word").alias("_first")).distinct()
    known = edge.withColumn("dir", F.element_at(names, F.col("rel"))).where("dir is not null")
    whole = known.where("src_word is null").select("dir", "src_pos", "src", "dst_pos", "dst")
    words = known.where("src_word is not null").join(first, ["src_pos", "src"]).where("src_word = _first").select("dir", "src_pos", "src", "dst_pos", "dst")
    return whole.unionByName(words).distinct()


def node(pos: Column, id_: Column) -> Column:
    """A concept as one number."""
    return id_ * 4 + F.instr(F.lit("nvar"), pos)


def ends_of(pairs: DataFrame) -> DataFrame:
    """pairs with both concepts as numbers, _na and _nb."""
    return pairs.withColumn("_na", node(F.col("pos_a"), F.col("a"))).withColumn("_nb", node(F.col("pos_b"), F.col("b")))


def concept_of(number: Column) -> tuple[Column, Column]:
    """pos and id of a concept's number."""
    return F.element_at(F.array(*map(F.lit, "nvar")), F.pmod(number - 1, F.lit(4)).cast("int") + 1), F.shiftright(number - 1, 2)


def numbered(steps: DataFrame, kind: str, back: bool = False) -> DataFrame:
    """(m, to): links of a kind between concepts as numbers, turned round with back."""
    here, there = ("dst", "src") if back else ("src", "dst")
    return steps.where(F.col("dir") == kind).select(node(F.col(f"{here}_pos"), F.col(here)).alias("m"), node(F.col(f"{there}_pos"), F.col(there)).alias("to"))


def walk(starts: DataFrame, steps: DataFrame, back: bool = False, ways: bool = False) -> DataFrame:
    """(start, m, n), written: the ends of all walks of n links, at most MAX_LINKS, from starts (m), which are distinct. With ways also
    `way`, of one such walk (the least): the concepts it leads to, in the order of the links; with back it leads from m to start."""
    level = materialize(starts.select(F.col("m").alias("start"), "m", *([F.array().cast("array<long>").alias("way")] if ways else [])))
    out = level.withColumn("n", F.lit(0))
    for n in range(1, MAX_LINKS + 1):
        on = level.join(steps, "m")
        # All walks of a start are in one task, and so stand together when they are packed.
        if ways:
            way = F.concat(F.array("m"), "way") if back else F.concat("way", F.array("to"))
            level = on.select("start", F.col("to").alias("m"), way.alias("way")).repartition("start").groupBy("start", "m").agg(F.min("way").alias("way"))
        else:
            level = on.select("start", F.col("to").alias("m")).repartition("start").distinct()
        level = materialize(level)  # so that no plan holds the levels before, and walks end where no link goes on
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("n", F.lit(n)))
    return out


@dataclass(frozen=True)
class Sides:
    """(start, m, n), with ways also way: from the first concepts of pairs up; from there along; back from the second concepts along
    downward links; and (_na, _nb, turned), the best walks down and then along, with ways also way and down, its links down."""

    up: DataFrame
    along: DataFrame
    down: DataFrame
    turned: DataFrame


def sides(own: DataFrame, steps: DataFrame, ways: bool = False) -> Sides:
    """For pairs own with _na and _nb. What is along of a concept is found once, for all that have it above them."""
    up = walk(own.select(F.col("_na").alias("m")).distinct(), numbered(steps, "U"), False, ways)
    level, level_back = numbered(steps, "H"), numbered(steps, "H", True)
    along = walk(level.select("m").distinct().join(up.select("m").distinct(), "m", "left_semi"), level, False, ways).where("n > 0")
    seconds = own.select(F.col("_nb").alias("m")).distinct()
    down = walk(seconds, numbered(steps, "D", True), True, ways)
    before = walk(level_back.select("m").distinct().join(seconds, "m", "left_semi"), level_back, True, ways).where("n > 0")
    # A second link after the turn costs one, whatever their number.
    before = before.withColumnRenamed("n", "h").withColumnRenamed("way", "_last")
    above = walk(before.where(f"h < {MAX_LINKS}").select("m").distinct(), numbered(steps, "D", True), True, ways).where("n > 0")
    both = before.join(above.select(F.col("start").alias("m"), F.col("m").alias("_na"), "n", *(["way"] if ways else [])), "m").where(f"h + n <= {MAX_LINKS}")
    worth = 8.0 - F.col("h") - F.col("n") - F.when(F.col("h") >= 2, 1).otherwise(0)
    key = ["_na", F.col("start").alias("_nb")]
    if ways:
        least = F.min(F.struct((-worth).alias("s"), F.concat("way", "_last").alias("way"), F.col("n").alias("down"))).alias("t")
        turned = both.groupBy(*key).agg(least).select("_na", "_nb", (-F.col("t.s")).alias("turned"), "t.way", "t.down")
    else:
        turned = both.groupBy(*key).agg(F.max(worth).alias("turned"))
    return Sides(up, along, down, turned)


def reach(up: DataFrame, along: DataFrame, ways: bool = False) -> DataFrame:
    """(start, nodes, marks): the concepts that walks up, and then along, reach from each start; a mark is links up x 8 + links along, a byte.
    With ways also `ways`, all their concepts one after the other: a mark tells how many are a walk's. Of walks along from one concept to another the
    shortest counts, and from a start itself also the shortest of more than one link, as one link alone is no walk."""
    least = F.min(F.struct("n", *(["way"] if ways else []))).alias("s")
    few = along.groupBy("start", "m", F.least("n", F.lit(2)).alias("few")).agg(least)
    whole = few.select("start", "m", "s").groupBy("start").agg(F.collect_list(F.struct("m", "s")).alias("r"))
    nearest = along.groupBy("start", "m").agg(least).where(f"s.n < {MAX_LINKS}").groupBy("start").agg(F.collect_list(F.struct("m", "s")).alias("r"))
    told = lambda way: [way.alias("ways")] if ways else []
    mark = lambda x: x.cast("array<tinyint>").alias("marks")
    own = whole.select("start", F.col("r.m").alias("nodes"), mark(F.col("r.s.n")), *told(F.flatten("r.s.way")))
    above = up.where(f"n between 1 and {MAX_LINKS - 1}").select("start", F.col("m").alias("via"), "n", *([F.col("way").alias("_up")] if ways else [])).join(nearest.withColumnRenamed("start", "via"), "via")
    above = above.select("start", F.col("r.m").alias("nodes"), mark(F.transform("r", lambda x: x["s"]["n"] + F.col("n") * 8)), *told(F.flatten(F.transform("r", lambda x: F.concat("_up", x["s"]["way"]))) if ways else None))
    bare = up.groupBy("start").agg(F.collect_list(F.struct("m", "n", *(["way"] if ways else []))).alias("r"))
    bare = bare.select("start", F.col("r.m").alias("nodes"), mark(F.transform("r.n", lambda n: n * 8)), *told(F.flatten("r.way") if ways else None))
    more = own.unionByName(above).groupBy("start").agg(*(F.flatten(F.collect_list(c)).alias(f"_{c}") for c in ("nodes", "marks", *(["ways"] if ways else []))))
    put = lambda c: F.concat(c, F.coalesce(f"_{c}", F.array().cast(dict(bare.dtypes)[c]))).alias(c)
    # Each start is in up, with no links.
    return bare.join(more, "start", "left").select("start", *(put(c) for c in bare.columns if c != "start"))


def best_meetings(batches: Iterator[pa.RecordBatch], ways: bool = False) -> Iterator[pa.RecordBatch]:
    """All rows, with `walk`: what the best walk over the concepts that both ends reach is worth, or null; with ways also `way`, the concepts that
    one such walk leads to, and how many of its links lead up and along."""

    def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)

    for batch in batches:
        kept = [c for c in batch.schema.names if c not in PACKED]
        row_a, node_a = flat(batch.column("nodes_a"))
        row_b, node_b = flat(batch.column("nodes_b"))
        mark_a, mark_b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("marks_a", "marks_b"))
        names, code = np.unique(np.concatenate([node_a, node_b]), return_inverse=True)
        key_a, key_b = row_a * len(names) + code[: len(node_a)], row_b * len(names) + code[len(node_a) :]
        order = np.argsort(key_b, kind="stable")
        low, high = (np.searchsorted(key_b[order], key_a, side=s) for s in ("left", "right"))
        size = high - low
        i = np.repeat(np.arange(len(key_a)), size)
        j = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
        up, along, down = mark_a[i] >> 3, mark_a[i] & 7, mark_b[j]
        total = up + along + down
        turns = np.where(
            (up > 0) & (along > 0) & (down > 0), np.where(down == 1, 2, 1),
            np.where((up > 0) & ((along > 0) | (down > 0)), 1, np.where((along > 0) & (down >= 2), 1, 0)),
        )
        at = np.flatnonzero((total >= 2) & (total <= MAX_LINKS))
        row, worth = row_a[i][at], (8 - total - turns)[at]
        best = np.full(batch.num_rows, -1, np.int64)
        np.maximum.at(best, row, worth)
        more, fields = [pa.array(best.astype(float), mask=best < 0)], ["walk"]
        if ways:
            first = np.lexsort((-worth, row))
            first = first[np.unique(row[first], return_index=True)[1]]
            told, first = row[first], at[first]
            part = []
            for side, entry, links in (("a", i[first], (mark_a >> 3) + (mark_a & 7)), ("b", j[first], mark_b)):
                part.append((flat(batch.column(f"ways_{side}"))[1], (np.cumsum(links) - links)[entry], links[entry]))
            (way_a, from_a, n_a), (way_b, from_b, n_b) = part
            whole, of = n_a + n_b, np.repeat(np.arange(len(told)), n_a + n_b)
            place = np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
            on_a, out = place < n_a[of], np.zeros(len(of), np.int64)
            out[on_a] = way_a[(from_a[of] + place)[on_a]]
            out[~on_a] = way_b[(from_b[of] + place - n_a[of])[~on_a]]
            sizes = np.zeros(batch.num_rows, np.int64)
            sizes[told] = whole
            more.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(out)))
            for part in (up, along):
                links = np.zeros(batch.num_rows, np.int32)
                links[told] = part[first]
                more.append(pa.array(links))
            fields += ["way", "up", "along"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], [*kept, *fields])


def met(own: DataFrame, found: Sides, ways: bool = False) -> DataFrame:
    """own, whose rows are pairs with _na and _nb, with the worth of the best meeting of both ends, `walk`, with ways also one such walk. It is found in
    the pair's row: pairs meet the second concepts first, above which there is less, and take only that along to the first."""
    columns = [c for c in PACKED if ways or c not in WAYS]
    from_a = reach(found.up, found.along, ways).withColumnRenamed("start", "_na")
    from_a = from_a.select("_na", *(F.col(c).alias(f"{c}_a") for c in from_a.columns if c != "_na"))
    from_b = found.down.groupBy(F.col("start").alias("_nb")).agg(F.collect_list(F.struct("m", "n", *(["way"] if ways else []))).alias("r"))
    from_b = from_b.select("_nb", F.col("r.m").alias("nodes_b"), F.col("r.n").cast("array<tinyint>").alias("marks_b"), *([F.flatten("r.way").alias("ways_b")] if ways else []))
    more = [T.StructField("walk", T.DoubleType()), *([T.StructField("way", T.ArrayType(T.LongType())), T.StructField("up", T.IntegerType()), T.StructField("along", T.IntegerType())] if ways else [])]
    both = own.join(from_b, "_nb", "left").join(from_a, "_na", "left").select(*own.columns, *columns)
    return both.mapInArrow(lambda batches: best_meetings(batches, ways), T.StructType([*own.schema.fields, *more]))


def medium_strong(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """pos_a, a, pos_b, b, score for pairs with a legal walk from a to b."""
    own = ends_of(pairs.select(KEYS).distinct())
    found = sides(own, steps)
    every = met(own.join(found.turned, ["_na", "_nb"], "left"), found)
    return every.select(*KEYS, F.greatest("walk", "turned").alias("score")).where("score is not null")


def told_way() -> Column:
    """Of rows that `met` gives with ways, and with the best walk down and then along as turned, _turned and down: the links of the better one, as
    (dir, pos, id) of the concept that each leads to; null without one."""
    by_turn = F.col("turned").isNotNull() & (F.col("walk").isNull() | (F.col("turned") > F.col("walk")))

    def link(x: Column, k: Column) -> Column:
        level = F.when(by_turn, F.when(k < F.col("down"), "D").otherwise("H")).otherwise(F.when(k < F.col("up"), "U").when(k < F.col("up") + F.col("along"), "H").otherwise("D"))
        pos, id_ = concept_of(x)
        return F.struct(level.alias("dir"), pos.alias("pos"), id_.alias("id"))

    return F.when(F.col("turned").isNotNull() | F.col("walk").isNotNull(), F.transform(F.when(by_turn, F.col("_turned")).otherwise(F.col("way")), link))


def best_walks(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """pos_a, a, pos_b, b, way for pairs with a legal walk from a to b: the links of one of the best, as (dir, pos, id)
    of the concept that each leads to. Only the walk that is told is put together, in the pair's row."""
    own = ends_of(pairs.select(KEYS).distinct())
    found = sides(own, steps, True)
    every = met(own.join(found.turned.withColumnRenamed("way", "_turned"), ["_na", "_nb"], "left"), found, True)
    return every.select(*KEYS, told_way().alias("way")).where("way is not null")


def walk_score(way: Column) -> Column:
    """The score of a walk, from its links alone."""
    dirs = F.array_join(F.transform(way, lambda x: x["dir"]), "")
    turns = (
        F.when(dirs.rlike("^U+H+D$"), 2).when(dirs.rlike("^U+(H+|D+|H+DD+)$"), 1).when(dirs.rlike("^(H+DD+|D+HH+)$"), 1).otherwise(0)
    )
    return 8.0 - F.length(dirs) - turns


#: Kinds of strong links, by their number, and what else there is.
KINDS = ("1 same concept", "2 horizontal link", "3 horizontal link back", "4 word within, link back")
#: Pairs that are sent to all tasks.
FEW_PAIRS = 1 << 16


def tied(own: DataFrame, steps: DataFrame) -> DataFrame:
    """(_na, _nb, tie): pairs of concepts with a horizontal link from the first to the second (2), or from the second to the first (3); and of own those
    that are `within` with an upward or downward link from the second to the first (4)."""
    src, dst = node(F.col("src_pos"), F.col("src")), node(F.col("dst_pos"), F.col("dst"))
    level, other = steps.where("dir = 'H'"), steps.where("dir in ('U', 'D')").select(dst.alias("_na"), src.alias("_nb"))
    asked = materialize(own.where("within").select("_na", "_nb").distinct())
    back = other.join(F.broadcast(asked) if asked.count() <= FEW_PAIRS else asked, ["_na", "_nb"], "left_semi")
    named = lambda rows, k, a, b: rows.select(a.alias("_na"), b.alias("_nb"), F.lit(k).alias("tie"))
    return named(level, 2, src, dst).unionByName(named(level, 3, dst, src)).unionByName(named(back, 4, F.col("_na"), F.col("_nb")))


def with_walks(pairs: DataFrame, steps: DataFrame, ways: bool = False) -> DataFrame:
    """The columns of pairs, which are written, with kind (the number of a strong link, or null) and score; with ways also way. Pairs have word_a and word_b, or
    `within`: whether one of these contains the other. Rows need not be distinct. Concepts are one number each while rows are moved."""
    within = F.col("word_a").contains(F.col("word_b")) | F.col("word_b").contains(F.col("word_a")) if "within" not in pairs.columns else F.col("within")
    known = ends_of(pairs).withColumn("_within", F.coalesce(within, F.lit(False)))
    own, steps = known.select("_na", "_nb", F.col("_within").alias("within")), materialize(steps)
    found = sides(own, steps, ways)
    # Links of pairs and their walks down and along come by one join.
    best = F.struct("turned", F.col("way").alias("_turned"), "down") if ways else F.struct("turned")
    none = F.lit(None)
    turned = found.turned.select("_na", "_nb", none.cast("int").alias("tie"), best.alias("_t"))
    every = turned.unionByName(tied(own, steps).withColumn("_t", none.cast(turned.schema["_t"].dataType)))
    of = every.groupBy("_na", "_nb").agg(F.min("tie").alias("tie"), F.max("_t").alias("_t"))
    more = [c for c in pairs.columns if c not in KEYS]
    tie = F.when(F.col("_na") == F.col("_nb"), 1).when((F.col("tie") < 4) | F.col("_within"), F.col("tie"))  # of rows of one pair not all need be within
    rows = known.select("_na", "_nb", "_within", *more).join(of, ["_na", "_nb"], "left").select("_na", "_nb", *more, tie.alias("_kind"), "_t.*")
    out = met(rows, found, ways)
    (pos_a, a), (pos_b, b) = concept_of(F.col("_na")), concept_of(F.col("_nb"))
    ends = {"pos_a": pos_a, "a": a, "pos_b": pos_b, "b": b}
    score = F.when(F.col("_kind").isNotNull(), float(STRONG)).otherwise(F.coalesce(F.greatest("walk", "turned"), F.lit(0.0)))
    return out.select(*(ends[c].alias(c) if c in ends else F.col(c) for c in pairs.columns), F.col("_kind").alias("kind"), score.alias("score"), *([F.when(F.col("_kind").isNull(), told_way()).alias("way")] if ways else []))


def relatedness(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """pairs (pos_a, a, word_a, pos_b, b, word_b), which are written, with score; none of their concepts and parts of speech is null. Order matters.

    16 for one concept; for a horizontal link either way; and where one word contains the other
    and the second concept has an upward or downward link to the first. Else the best walk, or 0.
    """
    return with_walks(pairs, steps).select(*pairs.columns, "score")


def provenance(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """pairs, which are distinct, with kind (of a strong link, 5 walk, or 6 none), way (the links of a best walk, else null) and score, from way and kind alone, which is that of `relatedness`."""
    found = with_walks(materialize(pairs), steps, True)
    # element_at gives the last element for a null place.
    kind = F.coalesce(*(F.when(F.col("kind") == n, name) for n, name in enumerate(KINDS, 1)), F.when(F.col("way").isNotNull(), "5 walk").otherwise("6 none"))
    score = F.when(F.col("kind").isNotNull(), float(STRONG)).when(F.col("way").isNotNull(), walk_score(F.col("way"))).otherwise(0.0)
    return found.select(*pairs.columns, kind.alias("kind"), "way", score.alias("score"))
