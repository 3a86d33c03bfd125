"""Files of frequencies, depths and word vectors: readers that check the header, and writers.

Parquet is the main form of these tables. The text forms are ordered, so a writer sorts by
range and writes parts in order; `single` gives one file where the table is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relspark.functions.text import pad_id
from relspark.lexicon import ROOT
from relspark.operators.joins import join_spread, running_total
from relspark.sources.splits import numbered_lines


class FormatError(ValueError):
    """A file that is not what it should be."""


def header(spark: SparkSession, path: str, prefix: str) -> str:
    """What follows the prefix in the file's first line."""
    first = spark.read.text(path).where(F.startswith("value", F.lit(prefix))).limit(1).collect()
    if not first:
        raise FormatError(f"{path} has no line {prefix}")
    return first[0]["value"][len(prefix) :].strip()


def check_version(spark: SparkSession, path: str, version: str | None) -> str:
    found = header(spark, path, "wnver::")
    if version is not None and found != version:
        raise FormatError(f"{path} is for version {found}, not {version}")
    return found


def body(spark: SparkSession, path: str, prefix: str = "wnver::") -> DataFrame:
    return spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit(prefix)))


def read_counts(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """(pos, id, freq, is_root) of an information content file. Of lines of one concept the last
    counts; any line of another form is an error. Line numbers come from the file's row order."""
    check_version(spark, path, version)
    m = r"^([0-9]+)([nvar])\s+([0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?)(\s+ROOT)?\s*$"
    rows = body(spark, path)
    bad = rows.where(~F.col("value").rlike(m)).limit(1).collect()
    if bad:
        raise FormatError(f"{path}: {bad[0]['value']!r}")
    part = lambda k: F.regexp_extract("value", m, k)
    made = rows.select(F.monotonically_increasing_id().alias("n"), part(2).alias("pos"), part(1).cast("long").alias("id"), part(3).cast("double").alias("freq"), (F.trim(part(4)) == "ROOT").alias("is_root"))
    return made.groupBy("pos", "id").agg(F.max_by(F.struct("freq", "is_root"), "n").alias("l")).select("pos", "id", "l.freq", "l.is_root")


def is_count_file(spark: SparkSession, path: str) -> bool:
    try:
        read_counts(spark, path)
        return True
    except FormatError:
        return False


def write_text(df: DataFrame, path: str, head: list[str], order: list, single: bool = True) -> None:
    """Lines in order below the head. df: the order's columns and line."""
    spark = df.sparkSession
    top = spark.createDataFrame([(h, i) for i, h in enumerate(head)], "line string, _i long")
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order) if not single else df.coalesce(1).sortWithinPartitions(*order)
    lines = parts.select("line")
    top.coalesce(1).sortWithinPartitions("_i").select("line").unionByName(lines).coalesce(1).write.text(path) if single else lines.write.text(path)


def find_counts(spark: SparkSession, folder: str, version: str | None) -> str:
    """The count file of this version (of any, without one) in a folder, the first by name; an error if there is none."""
    marks = spark.read.option("recursiveFileLookup", True).text(folder).where(F.startswith("value", F.lit("wnver::")))
    if version is not None:
        marks = marks.where(F.trim(F.substring("value", 8, 1_000)) == version)
    first = marks.select(F.input_file_name().alias("path")).orderBy("path").limit(1).collect()
    if not first:
        raise FormatError(f"{folder} has no count file{'' if version is None else f' of version {version}'}")
    return first[0]["path"]


def write_counts(counts: DataFrame, path: str, version: str, single: bool = True) -> None:
    freq = F.when(F.col("freq") == F.floor("freq"), F.col("freq").cast("long").cast("string")).otherwise(F.col("freq").cast("string"))
    line = F.concat(F.col("id").cast("string"), F.col("pos"), F.lit(" "), freq, F.when(F.col("is_root"), " ROOT").otherwise(""))
    write_text(counts.where("pos in ('n', 'v')").withColumn("line", line), path, [f"wnver::{version}"], [F.col("pos"), F.col("id")], single)


def read_synset_depths(spark: SparkSession, path: str, version: str | None = None, root_node: bool = True) -> DataFrame:
    """(pos, id, depth, root, place): the depths of each concept in the file's order. With a root
    node one more, and the root is the virtual one, which has depth 1."""
    check_version(spark, path, version)
    f = F.split(F.trim("value"), r"\s+")
    rows = body(spark, path).select(f[0].alias("pos"), f[1].cast("long").alias("id"), F.posexplode(F.slice(f, F.lit(3), F.size(f))).alias("place", "d"))
    rows = rows.select("pos", "id", F.split("d", ":")[0].cast("int").alias("depth"), F.split("d", ":")[1].cast("long").alias("root"), "place")
    if not root_node:
        return rows
    virtual = rows.select("pos").distinct().select("pos", F.lit(ROOT).cast("long").alias("id"), F.lit(1).alias("depth"), F.lit(ROOT).cast("long").alias("root"), F.lit(0).alias("place"))
    return rows.select("pos", "id", (F.col("depth") + 1).alias("depth"), F.lit(ROOT).cast("long").alias("root"), "place").unionByName(virtual)


def first_depth(depths: DataFrame) -> DataFrame:
    return depths.groupBy("pos", "id").agg(F.min_by(F.struct("depth", "root"), "place").alias("d")).select("pos", "id", "d.depth", "d.root")


def read_taxonomy_depths(spark: SparkSession, path: str) -> DataFrame:
    """(pos, root, depth)."""
    f = F.split(F.trim("value"), r"\s+")
    return body(spark, path).select(f[0].alias("pos"), f[1].cast("long").alias("root"), f[2].cast("int").alias("depth"))


def write_synset_depths(depths: DataFrame, path: str, version: str) -> None:
    """depths: pos, id, depth, root without a virtual root. Depths of a concept are sorted as strings."""
    each = F.concat(F.col("depth").cast("string"), F.lit(":"), pad_id(F.col("root")))
    rows = depths.groupBy("pos", "id").agg(F.array_sort(F.collect_set(each)).alias("d"))
    write_text(rows.withColumn("line", F.concat_ws(" ", "pos", pad_id(F.col("id")), F.array_join("d", " "))), path, [f"wnver::{version}"], [F.col("pos"), F.col("id")])


def write_taxonomy_depths(depths: DataFrame, path: str, version: str, names: DataFrame | None = None) -> None:
    """depths: pos, root, depth; names (pos, id, wps) write roots by name."""
    root = pad_id(F.col("root"))
    if names is not None:
        depths, root = depths.join(names.withColumnRenamed("id", "root"), ["pos", "root"], "left"), F.coalesce("wps", pad_id(F.col("root")))
    write_text(depths.withColumn("line", F.concat_ws(" ", "pos", root, F.col("depth").cast("string"))), path, [f"wnver::{version}"], [F.col("pos"), F.col("root")])


SECTIONS = ("-DIMENSIONS-", "-VECTORS-")


def write_vectors(path: str, n_docs: int, dims: DataFrame, vectors: DataFrame) -> None:
    """One text file: the number of documents, the dimensions (word, number, tf, df), the vectors (word, number count ..)."""
    numbered = running_total(dims.select("word", "tf", "df"), F.lit(1).cast("long"), [F.col("word")], "dim")
    first = numbered.select(F.lit(1).alias("s"), "word", F.concat_ws(" ", F.concat("word", F.lit(":")), F.col("dim").cast("string"), F.col("tf").cast("string"), F.col("df").cast("string")).alias("line"))
    known = numbered.select(F.col("word").alias("dim"), F.col("dim").alias("n"))
    cells = join_spread(vectors.join(known, "dim", "left_semi"), known, "dim")
    rows = cells.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cnt"))), lambda c: F.concat_ws(" ", c["n"].cast("string"), c["cnt"].cast("long").cast("string"))), " ").alias("v"))
    second = rows.select(F.lit(3).alias("s"), "word", F.concat("word", F.lit(": "), "v").alias("line"))
    marks = dims.sparkSession.createDataFrame([(0, "", SECTIONS[0]), (2, "", SECTIONS[1])], "s int, word string, line string")
    write_text(first.unionByName(second).unionByName(marks), path, [f"DOCUMENTCOUNT={n_docs}"], [F.col("s"), F.col("word")])


def read_vectors(spark: SparkSession, path: str) -> tuple[int, DataFrame, DataFrame]:
    """(documents, dims (word, dim, tf, df), vectors (word, dim, cnt)). Which section a line is of is told by its place: only the two
    lines that begin the sections are looked for first, then the file is read by splits."""
    n_docs = header(spark, path, "DOCUMENTCOUNT=")
    if not n_docs.isdigit():
        raise FormatError(f"{path}: DOCUMENTCOUNT={n_docs}")
    lines = numbered_lines(spark, path)
    place = F.struct("start", "at")
    found = lines.where(F.trim("value").isin(*SECTIONS)).orderBy("start", "at").limit(3).collect()
    if [r["value"].strip() for r in found] != list(SECTIONS):
        raise FormatError(f"{path}: sections are missing or out of order")
    first, second = (F.struct(F.lit(r["start"]).cast("long").alias("start"), F.lit(r["at"]).cast("long").alias("at")) for r in found)
    full = lines.where(F.trim("value") != "").select(place.alias("place"), F.element_at(F.split("value", ": ", 2), 1).alias("word"), F.split(F.element_at(F.split("value", ": ", 2), 2), " ").alias("f"))
    f = F.col("f")
    dims = full.where((F.col("place") > first) & (F.col("place") < second)).select("word", f[0].cast("int").alias("dim"), f[1].cast("long").alias("tf"), f[2].cast("long").alias("df"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("f") / 2).cast("int") - 1), lambda i: F.struct(F.element_at("f", i * 2 + 1).cast("int").alias("dim"), F.element_at("f", i * 2 + 2).cast("double").alias("cnt")))
    cells = full.where(F.col("place") > second).select("word", F.explode(pairs).alias("c"))
    return int(n_docs), dims, cells.select("word", "c.dim", "c.cnt")
