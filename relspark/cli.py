"""Commands: python -m relspark.cli COMMAND .. ; each is one Spark job over files of the public formats."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from relspark.functions import morph as mp
from relspark.lexicon import Lexicon
from relspark.operators import information as info, paths as pt, senses as sn, vectors as vec
from relspark.plans import measures as ms
from relspark.plans.cache import ScoreCache
from relspark.plans.provenance import TRACES
from relspark.sources import corpora, lists, tables, wndb


def read_text(path: str) -> str:
    with open(path) as f:  # a small option file of the user who calls
        return f.read()


def morph_of(spark: SparkSession, lexicon: Lexicon, words: DataFrame) -> DataFrame:
    return mp.morph_table(words, lexicon.sense)


def similarity(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Lines `sense  sense  score` of word pairs."""
    lexicon = wndb.read_lexicon(spark, a.wnpath)
    pairs = lists.read_word_pairs(spark, a.file) if a.file else spark.createDataFrame([tuple(a.words)], "w1 string, w2 string")
    options = lists.parse_config(read_text(a.config), a.type) if a.config else lists.Options({"rootNode": 1})
    if options.err_level > 1:
        raise SystemExit("; ".join(options.messages))
    for message in options.messages:
        print(message, file=sys.stderr)
    v = options.values
    if (a.trace or v.get("trace")) and a.type not in TRACES:
        print(f"trace: {a.type} has none.", file=sys.stderr)
    config = ms.Config(root_node=bool(v.get("rootNode", 1)), normalize=bool(v.get("normalize", 0)), max_random=v.get("maxrand", 1.0), text_size=v["textsize"] if v.get("textsize", -1) >= 0 else None, trace=a.trace or bool(v.get("trace", 0)))
    changes = {}
    if a.cachefolder and v.get("cache", 1):
        limit = v.get("maxCacheSize", "unlimited")
        changes["cache"] = ScoreCache(a.cachefolder, None if limit == "unlimited" else int(limit))
    if v.get("infocontent"):
        changes["counts"] = tables.read_counts(spark, v["infocontent"])
    elif a.type in ("res", "lin", "jcn"):
        if not a.icfolder:
            raise SystemExit(f"{a.type} needs an infocontent file, or --icfolder to find one in.")
        changes["counts"] = tables.read_counts(spark, tables.find_counts(spark, a.icfolder, a.version), a.version)
    if v.get("stop"):
        changes["stop"] = lists.stop_list(spark, v["stop"])
    if v.get("vectordb"):
        changes["vectors"] = tables.read_vectors(spark, v["vectordb"])[2].select("word", F.col("dim").cast("string").alias("dim"), "cnt")
    if v.get("synsetDepthsFile"):
        changes["synset_depths"] = tables.read_synset_depths(spark, v["synsetDepthsFile"], root_node=config.root_node)
    if v.get("taxonomyDepthsFile"):
        changes["taxonomy_depths"] = tables.read_taxonomy_depths(spark, v["taxonomyDepthsFile"])
    if a.type in ("vector", "vector_pairs"):
        changes["compounds"] = wndb.compounds(lexicon.sense)
    if v.get("stem"):
        texts = lexicon.synset.select(F.explode(F.regexp_extract_all(F.lower("gloss"), F.lit(r"(\w+)"), F.lit(1))).alias("word"))
        changes["stem"] = morph_of(spark, lexicon, texts.unionByName(lexicon.sense.select("word")).distinct())
    if v.get("relation"):
        text = read_text(v["relation"])
        changes |= {"vector_relations": lists.parse_vector_relations(text)} if a.type == "vector" else {"relations": lists.parse_relations(text)}
    from dataclasses import replace

    bare = pairs.select(F.explode(F.array("w1", "w2")).alias("w")).select(F.split("w", "#")[0].alias("word"))
    scored = ms.score_words(lexicon, pairs, a.type, replace(config, **changes), morph_of(spark, lexicon, bare), a.allsenses)
    line = lists.result_line(F.col("wps1"), F.col("wps2"), F.col("score"))
    if "trace" in scored.columns:
        line = F.concat_ws("\n", line, "trace")
    if a.offsets:
        scored = by_offset(by_offset(scored, "wps1", lexicon.sense), "wps2", lexicon.sense)
    return scored.orderBy(F.desc("score"), "wps1", "wps2").select(line.alias("line"))


def by_offset(scored: DataFrame, column: str, sense: DataFrame) -> DataFrame:
    """Sense strings of the column with the concept's id for the sense's number."""
    parts = [F.col(c) for c in ("word", "pos", "sense", "id")]
    names = sense.select(lists.sense_or_offset(*parts).alias(column), lists.sense_or_offset(*parts, offsets=True).alias("_named"))
    return scored.join(names, column, "left").withColumn(column, F.coalesce("_named", column)).drop("_named")


def count_corpus(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes an information content file from a corpus."""
    lexicon = wndb.read_lexicon(spark, a.wnpath, ("n", "v"))
    stop = lists.stop_list(spark, a.stopfile, "counter") if a.stopfile else None
    known = wndb.compounds(lexicon.sense)
    blocks = corpora.read(spark, a.infile, a.format, {"bnc": 2, "treebank": 1}.get(a.format))
    found = blocks.select("doc", F.col("block").alias("word")) if a.format == "semcor" else corpora.tokens(blocks, known, stop)
    own = info.count_words(found, morph_of(spark, lexicon, found), lexicon.sense, a.resnik)
    return finish_counts(spark, a, lexicon, own)


def finish_counts(spark: SparkSession, a: argparse.Namespace, lexicon: Lexicon, own: DataFrame) -> DataFrame:
    whole = info.propagate(info.add_one(own, lexicon.synset) if a.smooth else own, lexicon.synset, lexicon.isa)
    tables.write_counts(whole, a.outfile, a.version)
    return spark.createDataFrame([(a.outfile,)], "line string")


def sense_tags(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes an information content file from the counts of sense tags."""
    lexicon = wndb.read_lexicon(spark, a.wnpath, ("n", "v"))
    own = info.sense_tag_counts(wndb.read_cntlist(spark, f"{a.wnpath}/cntlist"), wndb.read_sense_index(spark, f"{a.wnpath}/index.sense"))
    return finish_counts(spark, a, lexicon, own)


def depths(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes the depths of concepts and of taxonomies."""
    lexicon = wndb.read_lexicon(spark, a.wnpath, ("n", "v"))
    if a.depthfile:
        paths = pt.root_paths(lexicon.isa, lexicon.synset, False)
        tables.write_synset_depths(pt.depths_and_roots(paths, False), a.depthfile, a.version)
    found = pt.taxonomy_depths(lexicon.synset, lexicon.isa, True)
    names = sn.canonical(found.select("pos", F.col("root").alias("id")), lexicon.sense) if a.wps else None
    tables.write_taxonomy_depths(found, a.outfile, a.version, names)
    return spark.createDataFrame([(a.outfile,)], "line string")


def word_vectors(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes word vectors from the definitions of all concepts."""
    from relspark.functions import text as tx

    lexicon = wndb.read_lexicon(spark, a.wnpath)
    gloss = tx.definition(F.col("gloss")) if a.noexamples else F.col("gloss")
    tokens = lexicon.synset.select(F.concat_ws("#", "pos", F.col("id").cast("string")).alias("doc"), F.explode(tx.words(tx.vector_words(gloss))).alias("word"))
    n = lexicon.synset.count()
    stop = lists.stop_list(spark, a.stopfile, "vector") if a.stopfile else None
    dims, made = vec.build_vectors(tokens, n, stop, a.chigh, a.clow, a.rhigh, a.rlow, a.cutoff)
    tables.write_vectors(a.outfile, n, dims, made)
    return spark.createDataFrame([(a.outfile,)], "line string")


def compounds(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return wndb.compounds(wndb.read_lexicon(spark, a.wnpath).sense).orderBy("word").select(F.col("word").alias("line"))


def rank(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(a.file).where(F.size(f) == 3).select(f[0].alias("w1"), f[1].alias("w2"), f[2].cast("double").alias("score"), F.monotonically_increasing_id().alias("n"))
    last = rows.groupBy("w1", "w2").agg(F.max_by("score", "n").alias("score"))
    return lists.ranking_lines(sn.rank_pairs(last).orderBy("rank", "w1", "w2"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="relspark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple) -> None:
        s = sub.add_parser(name, help=run.__doc__)
        s.set_defaults(run=run)
        for flag, kw in options:
            s.add_argument(flag, **kw)

    wn, out, version = ("--wnpath", {"required": True}), ("--outfile", {"required": True}), ("--version", {"default": "0"})
    command("similarity", similarity, wn, ("--type", {"required": True, "choices": sorted(ms.MEASURES)}), ("--config", {}), ("--file", {}), ("--cachefolder", {}), ("--icfolder", {}), ("--version", {}), *((f"--{x}", {"action": "store_true"}) for x in ("allsenses", "offsets", "trace")), ("words", {"nargs": "*"}))
    command("count", count_corpus, wn, out, version, ("--format", {"default": "raw", "choices": ["raw", "brown", "bnc", "treebank", "semcor"]}), ("--infile", {"nargs": "+", "required": True}), ("--stopfile", {}), ("--resnik", {"action": "store_true"}), ("--smooth", {"action": "store_true"}))
    command("tags", sense_tags, wn, out, version, ("--smooth", {"action": "store_true"}))
    command("depths", depths, wn, out, version, ("--depthfile", {}), ("--wps", {"action": "store_true"}))
    command("vectors", word_vectors, wn, out, ("--stopfile", {}), ("--noexamples", {"action": "store_true"}), ("--cutoff", {"type": float}), *((f"--{x}", {"type": int}) for x in ("rhigh", "rlow", "chigh", "clow")))
    command("compounds", compounds, wn)
    command("rank", rank, ("--file", {"required": True}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("relspark").getOrCreate()
    for row in a.run(spark, a).toLocalIterator():  # the lines go to the caller's terminal
        print(row["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
