"""Reading text files by splits, with units of text that go on across the splits' borders.

Spark cuts large files into splits of lines and reads each in order. What a unit is depends on
the markup, a clause or what stands between two tags; its border may be anywhere in a line,
so a unit may begin in one split and end in the next, or many splits later. Each split
gives its whole units at once, and a summary: what stands before its first border, what stands
after its last, and whether there is any. The summaries of a file, two rows for each split, tell by a running
count which of those pieces belong together; joined in the order of the file, they are cut again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


class Markup(NamedTuple):
    """border: a pattern without groups, in the syntax that Python and Java share; it matches no other text
    when more follows, except that a match which begins with `open` may go on in the next line. line: what is done to each line
    first; unit: to each unit, whose lines are still apart. headless: what stands before a file's first border does not count."""

    border: str
    unit: Callable[[Column], Column]
    line: Callable[[Column], Column] | None = None
    open: str | None = None
    headless: bool = False


#: Whole units, pieces before the first and after the last border, and splits without one.
WHOLE, HEAD, TAIL, THROUGH = range(4)
PIECES = "doc string, start long, at long, kind int, text string"


def lines_of(spark: SparkSession, paths: list[str] | str, line: Callable[[Column], Column] | None, recursive: bool = True) -> DataFrame:
    """(doc, start, value): lines in the order of each split, which is named by its file and the byte where it starts."""
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive).text([paths] if isinstance(paths, str) else paths)
    value = F.col("value")
    return rows.select(F.input_file_name().alias("doc"), F.col("_metadata.file_block_start").alias("start"), (line(value) if line else value).alias("value"))


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Neighbouring lines of a batch that are of one split."""
    doc = batch.column("doc").dictionary_encode()
    code, start = doc.indices.to_numpy(), batch.column("start").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (start[1:] != start[:-1])])) if len(code) else []
    for lo, hi in zip(first, [*first[1:], len(code)]):
        yield (doc.dictionary[code[lo]].as_py(), int(start[lo])), batch.column("value").slice(lo, hi - lo).to_pylist()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, start, at, value): lines with their number in their split, so that (start, at) is the order of a file."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n = None, 0
        for batch in batches:
            for key, lines in runs(batch):
                split, n = key, n if key == split else 0
                yield rows([(*key, n + k, WHOLE, line) for k, line in enumerate(lines)])
                n += len(lines)

    return lines_of(spark, path, None).mapInArrow(number, PIECES).select("doc", "start", "at", F.col("text").alias("value"))


def cutter(border: str, open_: str | None, summary: bool):
    """Makes pieces of the lines of a task: with summary only those at the splits' borders, else only whole units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(border)
        split: tuple[str, int] | None = None
        held: list[str] = []  # what stands after the last border, in parts that hold none
        loose = ""  # and what may be the beginning of one
        n = 0  # borders so far
        out: list[tuple] = []

        def close() -> None:
            if split is not None and summary:
                out.append((*split, n, TAIL if n else THROUGH, "".join(held) + loose))

        for batch in batches:
            for key, lines in runs(batch):
                if key != split:
                    close()
                    split, held, loose, n = key, [], "", 0
                text = loose + "\n".join(lines) + "\n"
                at = text.rfind(open_) if open_ else -1
                if at >= 0 and ">" not in text[at:]:
                    text, loose = text[:at], text[at:]
                else:
                    loose = ""
                first, *rest = cut.split(text)
                held.append(first)
                if rest:
                    unit, held = "".join(held), [rest.pop()]
                    if n == 0 and summary:
                        out.append((*split, 0, HEAD, unit))
                    if not summary:
                        found = [unit, *rest] if n else rest
                        out.extend((*split, n + k + (n == 0), WHOLE, u) for k, u in enumerate(found) if u and not u.isspace())
                    n += len(rest) + 1
            if out:
                yield rows(out)
                out.clear()
        close()
        yield rows(out)

    return run


def rows(found: list[tuple]) -> pa.RecordBatch:
    doc, start, at, kind, text = zip(*found) if found else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.string()), pa.array(start, pa.int64()), pa.array(at, pa.int64()), pa.array(kind, pa.int32()), pa.array(text, pa.string())], ["doc", "start", "at", "kind", "text"])


def across(pieces: DataFrame, border: str, headless: bool) -> DataFrame:
    """(doc, at, text): units that reach over splits' borders, from the pieces of all splits."""
    # A split's first piece goes on with what the splits before it left open; only a split with a border opens a new unit.
    before = Window.partitionBy("doc").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = pieces.withColumn("unit", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(before))
    ordered = F.array_sort(F.collect_list(F.struct("start", "kind", "at", "text")))
    joined = opened.groupBy("doc", "unit").agg(ordered.alias("p")).select("doc", "unit", F.array_join(F.col("p.text"), "").alias("text"), (F.col("p")[0]["start"] + F.col("p")[0]["at"]).alias("at"))
    cut = F.split("text", border)
    kept = F.when((F.col("unit") == 0) & F.lit(headless), F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)
    return joined.select("doc", "at", F.posexplode(kept).alias("k", "text")).select("doc", (F.col("at") + F.col("k")).alias("at"), "text")


def read_units(spark: SparkSession, paths: list[str] | str, markup: Markup, recursive: bool = True) -> DataFrame:
    """(doc, at, block): the units of all files that hold more than blanks. at grows with the place in the file.

    Files are read by splits (spark.sql.files.maxPartitionBytes), so a single large one uses all tasks; a compressed one is one
    split. The files are read twice: for the summaries and for the units. A task holds a batch of lines and one unit. An empty file gives
    nothing; a file of one line without any border is one unit.
    """
    lines = lines_of(spark, paths, markup.line, recursive)
    whole = lines.mapInArrow(cutter(markup.border, markup.open, False), PIECES).select("doc", (F.col("start") + F.col("at")).alias("at"), "text")
    pieces = lines.mapInArrow(cutter(markup.border, markup.open, True), PIECES)
    found = whole.unionByName(across(pieces, markup.border, markup.headless))
    return found.select("doc", "at", markup.unit(F.col("text")).alias("block")).where(F.trim("block") != "")
