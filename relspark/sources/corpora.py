"""Readers of text corpora in five markups. Each gives (doc, at, block): blocks of text to count words in.

`read` takes files by splits of lines, so that one large file is many tasks (see splits.py). The
functions named by their markup take texts that are whole already, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relspark.functions import text as tx
from relspark.sources.splits import Markup, read_units


def whole_files(spark: SparkSession, paths: list[str] | str, recursive: bool = True, depth: int | None = None) -> DataFrame:
    """(doc, text) of files, folders or patterns; depth: only files that many folders below the path."""
    given = [paths] if isinstance(paths, str) else paths
    if depth is not None:
        given = [f"{p.rstrip('/')}{'/*' * (depth + 1)}" for p in given]
    rows = spark.read.option("recursiveFileLookup", recursive and depth is None).text(given, wholetext=True)
    return rows.select(F.input_file_name().alias("doc"), F.col("value").alias("text"))


def in_blocks(docs: DataFrame, blocks: Column) -> DataFrame:
    """Blocks that hold words."""
    return docs.select("doc", F.posexplode(blocks).alias("at", "block")).where(F.trim("block") != "")


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\f?", ""), "\n", " ")


def raw_text(docs: DataFrame, strict: bool = True) -> DataFrame:
    """Clauses, cut at . ? ! , ; and colons; lines do not end a clause. Not strict: a mark at the
    end of a line does not cut either, as in the reference."""
    text = F.col("text") if strict else F.regexp_replace("text", r"[.?!,;:]+(?=[\r\f]*(\n|\z))", "")
    return in_blocks(docs, F.split(one_line(text), "[.?!,;:]"))


def brown(docs: DataFrame) -> DataFrame:
    """Sentences; lines begin with a code and a number."""
    bare = F.regexp_replace("text", r"(?m)^[A-Z]+[0-9]+ [0-9]+ ", "")
    return in_blocks(docs, F.split(one_line(bare), "[.?!]"))


def bnc(docs: DataFrame) -> DataFrame:
    """Sentences of marked-up text: what stands before the first <s> does not count, and
    entities and what is in brackets leave nothing behind."""
    bare = bare_bnc(F.col("text"))
    parts = F.split(one_line(bare), r"</?s(?:\s+[^>]*)?>")
    return in_blocks(docs, F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.regexp_replace(p, "<[^>]*>", " ")))


def treebank(docs: DataFrame) -> DataFrame:
    """Blocks between blank lines, without .START."""
    return in_blocks(docs, F.transform(F.split(F.regexp_replace("text", r"\.START", ""), r"\n[ \t\r]*\n"), lambda p: one_line(p)))


def semcor_lemmas(docs: DataFrame) -> DataFrame:
    """(doc, word): the lemma of each word that is done; sense tags do not count."""
    tags = F.regexp_extract_all("text", F.lit(r"(<wf [^>]*cmd=done[^>]*>)"), F.lit(1))
    lemma = F.transform(tags, lambda t: F.regexp_extract(t, r"lemma=([^\s>]+)", 1))
    return docs.select("doc", F.explode(F.filter(lemma, lambda x: x != "")).alias("word"))


def bare_bnc(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "&([a-z0-9]*;)+", ""), r"\[[^\]\n]*\]", "")


#: Stands for a blank line, as the text around it may be in another batch of lines.
BLANK_LINE = "\x1e"


def blank_line(line: Column) -> Column:
    bare = F.translate(F.regexp_replace(line, r"\.START", ""), BLANK_LINE, " ")
    return F.when(bare.rlike(r"\A[ \t\r]*\z"), F.lit(BLANK_LINE)).otherwise(bare)


def done_lemma(text: Column) -> Column:
    """The lemma of a tag that ends the text."""
    return F.regexp_extract(F.regexp_extract(text, r"(?s)<wf ([^>]*cmd=done[^>]*)\z", 1), r"lemma=([^\s>]+)", 1)


#: What `read` knows: the same units that the functions above find in whole texts.
MARKUPS = {
    "raw": Markup("[.?!,;:]", one_line),
    "raw_loose": Markup("[.?!,;:]", one_line, lambda t: F.regexp_replace(t, r"[.?!,;:]+(?=[\r\f]*\z)", "")),
    "brown": Markup("[.?!]", one_line, lambda t: F.regexp_replace(t, r"\A[A-Z]+[0-9]+ [0-9]+ ", "")),
    "bnc": Markup(r"</?s(?:\s+[^>]*)?>", lambda t: F.regexp_replace(one_line(t), "<[^>]*>", " "), bare_bnc, "<", True),
    "treebank": Markup(BLANK_LINE, one_line, blank_line),
    "semcor": Markup(">", done_lemma),
}


def read(spark: SparkSession, paths: list[str] | str, markup: str, depth: int | None = None) -> DataFrame:
    """(doc, at, block) of files, folders or patterns; depth: only files that many folders below the path. For
    semcor the blocks are lemmas, and a tag that the end of a file cuts off counts as a whole one."""
    if markup not in MARKUPS:
        raise ValueError(f"no markup {markup!r}; there are {', '.join(sorted(MARKUPS))}")
    given = [paths] if isinstance(paths, str) else paths
    if depth is not None:
        given = [f"{p.rstrip('/')}{'/*' * (depth + 1)}" for p in given]
    return read_units(spark, given, MARKUPS[markup], depth is None)


def tokens(blocks: DataFrame, compounds: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(doc, word): the words of blocks, with compounds joined and stop words gone."""
    clean = blocks.select("doc", tx.corpus_words(F.col("block")).alias("text"))
    if compounds is not None:
        from relspark.functions.compounds import compoundify

        clean = compoundify(clean, "text", compounds, "text")
    found = clean.select("doc", F.explode(tx.words(F.col("text"))).alias("word"))
    return found if stop is None else found.join(stop.select("word").distinct(), "word", "left_anti")
