"""Small inputs: relation files, stop lists, word pairs, configurations, and the lines that results are written as."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relspark.functions.text import pad_id
from relspark.operators.relations import TYPES, check_types
from relspark.sources.tables import FormatError


def expression(text: str) -> list[str]:
    """Functions from the innermost out: `example(hype(hype))` is hype, hype, example."""
    bare = re.sub(r"\s", "", text)
    if not re.fullmatch(r"\w+(\(\w+)*\)*", bare) or bare.count("(") != bare.count(")"):
        raise FormatError(f"bad expression {text!r}")
    return bare.replace(")", "").split("(")[::-1]


def parse_relations(text: str) -> list[tuple[list[str], list[str], float]]:
    """Lines `f(g)-h weight` below a header that holds RelationFile. The weight is 1 unless it is given."""
    rows = text.splitlines()
    if not rows or "RelationFile" not in rows[0]:
        raise FormatError("the first line does not hold RelationFile")
    out = []
    for row in filter(None, (r.strip() for r in rows[1:])):
        pair, _, weight = row.partition(" ") if not re.search(r"\s-|-\s", row) else (re.sub(r"\s*-\s*", "-", row).split()[0], "", " ".join(re.sub(r"\s*-\s*", "-", row).split()[1:]))
        sides = pair.split("-")
        if len(sides) != 2:
            raise FormatError(f"bad line {row!r}")
        left, right = (check_types(expression(s)) for s in sides)
        out.append((left, right, float(weight) if weight.strip() else 1.0))
    return out


def parse_vector_relations(text: str) -> list[list[str]]:
    """Single expressions below a header VectorRelationFile; concepts at the end become glosexample."""
    rows = text.splitlines()
    if not rows or "VectorRelationFile" not in rows[0]:
        raise FormatError("the first line does not hold VectorRelationFile")
    out = []
    for row in filter(None, (r.strip() for r in rows[1:])):
        functions = expression(row.split()[0])
        if functions[-1] in TYPES and TYPES[functions[-1]][1] == 1:
            functions = [*functions, "glosexample"]
        out.append(check_types(functions))
    return out


def stop_list(spark: SparkSession, path: str, style: str = "measure") -> DataFrame:
    """(word) of one word a line. measure: trimmed, blanks within become underscores; counter: as
    it is; vector: without any blank."""
    value = {"measure": F.regexp_replace(F.trim("value"), r"\s+", "_"), "counter": F.col("value"), "vector": F.regexp_replace("value", r"\s+", "")}[style]
    return spark.read.text(path).select(value.alias("word")).where("word <> ''").distinct()


def word_pairs(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with w1, w2 and ok. A line from # on, or from // on, is a comment; what is left must be
    two words, else ok is false. Lines without anything else are dropped."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(value, r"^\s*#.*$", ""), "//.*$", ""))
    parts = F.split(bare, r"\s+")
    two = F.size(parts) == 2
    return lines.where(bare != "").select("*", F.when(two, parts[0]).alias("w1"), F.when(two, parts[1]).alias("w2"), two.alias("ok"))


def read_word_pairs(spark: SparkSession, path: str) -> DataFrame:
    return word_pairs(spark.read.text(path)).where("ok").select("w1", "w2")


#: Options of every measure, and of some: (type, default). Types: i whole number, f decimal, s text, p path.
COMMON = {"trace": ("i", 0), "cache": ("i", 1), "maxCacheSize": ("s", 5000)}
TAXONOMY = {"rootNode": ("i", 1)}
OPTIONS = {
    "path": TAXONOMY, "wup": TAXONOMY | {"synsetDepthsFile": ("p", None)}, "lch": TAXONOMY | {"synsetDepthsFile": ("p", None), "taxonomyDepthsFile": ("p", None)},
    **{m: TAXONOMY | {"infocontent": ("p", None)} for m in ("res", "lin", "jcn")}, "hso": {},
    "lesk": {"relation": ("p", None), "stop": ("p", None), "stem": ("i", 0), "normalize": ("i", 0)},
    "vector": {"relation": ("p", None), "stop": ("p", None), "stem": ("i", 0), "vectordb": ("p", None), "textsize": ("i", -1)},
    "vector_pairs": {"relation": ("p", None), "stop": ("p", None), "stem": ("i", 0), "vectordb": ("p", None)},
    "random": {"maxrand": ("f", 1.0)},
}


@dataclass
class Options:
    values: dict = field(default_factory=dict)
    err_level: int = 0
    messages: list[str] = field(default_factory=list)


def parse_config(text: str, measure: str) -> Options:
    """The first line names the measure; then `name::value` lines, # comments. Faults give err_level 1
    and keep the default; a wrong first line is level 2."""
    known = COMMON | OPTIONS[measure]
    out = Options({k: d for k, (_, d) in known.items()})
    rows = [re.sub(r"#.*", "", r).strip() for r in text.splitlines()]
    rows = [r for r in rows if r]
    if not rows or rows[0].rpartition("::")[2] != measure:
        return Options(out.values, 2, [f"The file is not for {measure}."])

    def fault(message: str) -> None:
        out.err_level = max(out.err_level, 1)
        out.messages.append(message)

    seen: set[str] = set()
    for row in rows[1:]:
        name, mark, value = (x.strip() for x in re.sub(r"\s", "", row).partition("::"))
        if not mark or name not in known:
            fault(f"Unknown option {name}.")
            continue
        if name in seen:
            fault(f"{name} is given twice.")
        seen.add(name)
        if value == "":
            continue
        kind = known[name][0]
        good = {"i": r"\d+", "f": r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", "s": r".+", "p": r".+"}[kind]
        fine = re.fullmatch(good, value, re.I) is not None
        fine &= {"trace": value in "012", "cache": value in "01", "maxCacheSize": value == "unlimited" or value.isdigit()}.get(name, True)
        if not fine:
            fault(f"{name} can't be {value}.")
            continue
        out.values[name] = {"i": int, "f": float}.get(kind, str)(value)
    return out


def result_line(left: Column, right: Column, score: Column) -> Column:
    return F.concat_ws("  ", left, right, score.cast("string"))


def sense_or_offset(word: Column, pos: Column, sense: Column, id_: Column, offsets: bool = False) -> Column:
    return F.concat_ws("#", word, pos, pad_id(id_) if offsets else sense.cast("string"))


def ranking_lines(ranked: DataFrame) -> DataFrame:
    """(line) of ranked pairs (w1, w2, rank, score)."""
    return ranked.select(F.concat(F.concat_ws("<>", "w1", "w2", F.col("rank").cast("string")), F.lit(" "), F.format_string("%.2f", "score"), F.lit(" 0 0 0")).alias("line"))
