"""Secret scans. DataFrame functions only.

Three patterns give base spans. Beyond them, long tokens of mixed characters are put to a
battery of randomness tests: the alphabet is inferred (hexadecimal, base 32, base 64); the
counts of its symbols are tested for uniformity (chi-squared), their order for randomness
(runs of symbols above and below the middle, runs of lower case, upper case and digits,
serial correlation).

Each test gives a factor of evidence: how much likelier its result is for random symbols
than for words and names. Deviates of the first three are standard normal for random
symbols, and for words three times as wide at least; classes change at each symbol with
the alphabet's own probability, in words with ``WORD_CHANGES`` at most. The product is
expected to be at most one for a word, whatever its length, so its inverse serves as a
p-value; long tokens gather more evidence. The step-up procedure after Benjamini and
Hochberg over all tokens of the text picks the discoveries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed patterns. Letters of the first group count in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 8
#: Tokens that are tested.
MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}={{0,2}}"
WORD_CHANGES, WORD_SPREAD, FALSE_SHARE = 0.1, 3.0, 0.01
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Probability that neighbouring random symbols are of different classes (digits, upper case, lower case, marks).
CHANGES = {"hex": 2 * 10 * 6 / 16**2, "base32": 2 * 26 * 6 / 32**2, "base64": 1 - (26**2 + 26**2 + 10**2 + 2**2) / 64**2}
SPAN = "array<struct<start:long,end:long,value:string>>"
#: Elements of an array that one fold runs over.
FOLD = 128


def running(df: DataFrame, values: str, out: str, combine) -> DataFrame:
    """Adds out: for each element of an array of longs all up to it combined (an associative function
    of two columns). Folds grow an array of FOLD elements at most, and one of the blocks' results,
    so a long array takes no time that grows with its square to speak of."""

    def fold(x: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            return F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(combine(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), v))))

        return F.aggregate(x, F.array().cast("array<long>"), step)

    many = F.ceil(F.size(values) / FOLD).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), many - 1), lambda b: F.slice(values, b * FOLD + 1, F.lit(FOLD)))
    inner, upto = f"{out}_inner", f"{out}_upto"
    df = df.withColumn(inner, F.when(F.size(values) > 0, F.transform(blocks, fold)))
    df = df.withColumn(upto, F.when(F.size(inner) > 1, fold(F.transform(F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0))), lambda x: F.get(x, F.size(x) - 1)))))
    # The first block stands as it is; each other one goes on from those before it.
    rest = F.zip_with(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 1, F.lit(0))), upto, lambda x, base: F.transform(x, lambda v: combine(base, v)))
    whole = F.when(F.size(inner) > 1, F.concat(F.get(inner, F.lit(0)), F.flatten(rest))).otherwise(F.get(inner, F.lit(0)))
    return df.withColumn(out, F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<long>"))).drop(inner, upto)


def spans(df: DataFrame, name: str, pattern: str, group: int = 0) -> DataFrame:
    """Adds a column of that name with the matches in `_text`, empty without one."""
    p, text = F.lit(pattern), F.col("_text")
    hit = text.rlike(pattern)
    found = (
        df.withColumn("_whole", F.when(hit, F.regexp_extract_all(text, p, F.lit(0))))
        .withColumn("_value", F.when(F.size("_whole") > 0, F.regexp_extract_all(text, p, F.lit(group)) if group else F.col("_whole")))
        # What stands before a match, and the match, in turn; the last gap has no match.
        .withColumn("_gap", F.when(F.size("_whole") > 0, F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))))
        .withColumn("_size", F.transform("_whole", lambda x: F.length(x).cast("long")))
        .withColumn("_step", F.zip_with(F.slice("_gap", F.lit(1), F.size("_whole")), "_size", lambda g, n: g + n))
    )
    found = running(found, "_step", "_end", lambda a, b: a + b)
    placed = F.zip_with(
        F.arrays_zip(F.col("_end").alias("end"), F.col("_size").alias("size")), "_value",
        lambda e, v: F.struct((e["end"] - e["size"]).alias("start"), e["end"].alias("end"), v.alias("value")),
    )
    return found.withColumn(name, F.when(F.size("_whole") > 0, placed).otherwise(F.array().cast(SPAN))).drop("_whole", "_value", "_gap", "_size", "_step", "_end")


def char(text: Column, i: Column) -> Column:
    return F.substring(text, i, F.lit(1))


def upper_tail_z(chi2: Column, df: Column) -> Column:
    """Normal deviate of a chi-squared value, after Wilson and Hilferty."""
    v = F.lit(2.0) / (F.lit(9.0) * df)
    return (F.pow(chi2 / df, F.lit(1 / 3)) - (F.lit(1.0) - v)) / F.sqrt(v)


def battery(token: Column) -> Column:
    """struct(encoding, chi_z, runs_z, serial_z, p) of a token: deviates from randomness, and the
    inverse of the evidence against a word, 1 at most. Written as nested transforms of
    one-element arrays, each of which names what the next one uses."""

    def let(value: Column, then) -> Column:
        return F.transform(F.array(value), then)[0]

    def classes(s: Column) -> Column:
        # of digits, upper and lower case, one letter each; marks are a class of their own
        return F.translate(s, "123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_", "0" * 9 + "A" * 26 + "a" * 26 + "+" * 4)

    def tests(x: Column) -> Column:
        symbols, n, k = x["symbols"], x["n"], x["k"]
        squares = F.aggregate(
            F.sequence(F.lit(1), k), F.lit(0.0),
            lambda acc, i: acc + F.pow(n - F.length(F.replace(x["body"], char(x["alphabet"], i), F.lit(""))).cast("double"), F.lit(2.0)),
        )
        chi2 = k * squares / n - n
        mean = F.aggregate(symbols, F.lit(0.0), lambda acc, v: acc + v) / n
        pairs = F.zip_with(F.slice(symbols, F.lit(1), F.size(symbols) - 1), F.slice(symbols, F.lit(2), F.size(symbols) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        half = k / 2
        return F.struct(
            x["encoding"].alias("encoding"), n.alias("n"), upper_tail_z(chi2, k - 1.0).alias("chi_z"),
            F.aggregate(symbols, F.lit(0.0), lambda acc, v: acc + F.when(v >= half, 1.0).otherwise(0.0)).alias("high"),
            F.aggregate(pairs, F.lit(1.0), lambda acc, v: acc + F.when((v["a"] >= half) != (v["b"] >= half), 1.0).otherwise(0.0)).alias("runs"),
            F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + (v["a"] - mean) * (v["b"] - mean)).alias("lagged"),
            F.aggregate(symbols, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)).alias("spread"),
            (F.length(F.regexp_replace(x["classes"], r"(.)\1*", "x")) - 1).cast("double").alias("changes"),
        )

    def verdict(t: Column) -> Column:
        n, high = t["n"], t["high"]
        low = n - high
        expected = F.lit(2.0) * high * low / n + 1.0
        variance = (expected - 1.0) * (expected - 2.0) / (n - 1.0)
        m, c = n - 1.0, t["changes"]
        rate = F.when(t["encoding"] == "hex", CHANGES["hex"]).when(t["encoding"] == "base32", CHANGES["base32"]).otherwise(CHANGES["base64"])
        classes_ = c * F.ln(rate / WORD_CHANGES) + (m - c) * F.ln((F.lit(1.0) - rate) / (1.0 - WORD_CHANGES))
        # With all symbols on one side, or alike, the order tests have nothing to go by: that is not random.
        runs_z = F.when(variance > 0, (t["runs"] - expected) / F.sqrt(F.when(variance > 0, variance).otherwise(1.0))).otherwise(99.0)
        serial_z = F.when(t["spread"] > 0, t["lagged"] / F.when(t["spread"] > 0, t["spread"]).otherwise(1.0) * F.sqrt(n)).otherwise(99.0)
        # Logarithm of the density of a standard normal deviate over one WORD_SPREAD times as wide.
        factor = lambda z: F.lit(math.log(WORD_SPREAD)) - z * z * (0.5 - 0.5 / WORD_SPREAD**2)
        evidence = classes_ + factor(t["chi_z"]) + factor(runs_z) + factor(serial_z)
        return F.struct(t["encoding"].alias("encoding"), t["chi_z"].alias("chi_z"), runs_z.alias("runs_z"), serial_z.alias("serial_z"), F.exp(-F.greatest(evidence, F.lit(0.0))).alias("p"))

    def prepared(s: Column) -> Column:
        body = F.translate(F.rtrim(F.translate(s, "=", " ")), "-_", "+/")
        is_hex = F.lower(body).rlike("^[0-9a-f]+$") & ((F.lower(body) == body) | (F.upper(body) == body))
        encoding = F.when(is_hex, "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
        alphabet = F.when(is_hex, ALPHABETS["hex"]).when(body.rlike("^[A-Z2-7]+$"), ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
        return F.struct(F.when(is_hex, F.lower(body)).otherwise(body).alias("body"), encoding.alias("encoding"), alphabet.alias("alphabet"), classes(body).alias("classes"))

    def measured(x: Column) -> Column:
        return F.struct(
            x["body"].alias("body"), x["encoding"].alias("encoding"), x["alphabet"].alias("alphabet"), x["classes"].alias("classes"),
            F.length(x["body"]).cast("double").alias("n"), F.length(x["alphabet"]).alias("k"),
            F.transform(F.split(x["body"], ""), lambda c: F.instr(x["alphabet"], c).cast("double") - 1.0).alias("symbols"),
        )

    return let(prepared(token), lambda a: let(measured(a), lambda x: let(tests(x), verdict)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, spans (array of kind, start, end in code points, by
    start and then kind as in KINDS) and base (those of the three patterns).

    Random tokens that touch a base span are not reported again. A null text counts as empty.
    Null and repeated ids are kept, other columns not read. An empty table gives an empty result.
    """
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = spans(df, "_assign", ASSIGN, 2).withColumn("_assign", F.filter("_assign", lambda s: F.length(s["value"]) >= MIN_VALUE))
    df = spans(spans(spans(df, "_access", ACCESS), "_hex", HEX), "_token", TOKEN)

    def of_kind(column: str, kind: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    tested = F.transform(
        "_token",
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(mixed(s), battery(s["value"])).alias("b")),
    )
    df = df.withColumn("_base", F.array_sort(F.concat(of_kind("_assign", 0), of_kind("_access", 1), of_kind("_hex", 2))))
    df = df.withColumn("_tested", F.when(F.size("_token") > 0, tested))
    df = df.withColumn("_passed", F.filter("_tested", lambda t: t["b"].isNotNull() & (t["b"]["p"] <= FALSE_SHARE)))
    # Step up: the largest p that is at most its rank's share of the level, over all tokens.
    ranked = F.transform(F.array_sort(F.transform("_passed", lambda t: t["b"]["p"])), lambda p, i: F.when(p <= F.lit(FALSE_SHARE) * (i + 1) / F.size("_token"), p))
    df = df.withColumn("_limit", F.when(F.size("_passed") > 0, F.array_max(ranked)))
    # Discoveries and base spans in order of their starts; a token is apart if all bases that begin before
    # it end before it, and the next one begins after its end.
    chosen = F.transform(F.filter("_passed", lambda t: t["b"]["p"] <= F.col("_limit")), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    df = df.withColumn("_mixed", F.when(F.col("_limit").isNotNull(), F.array_sort(F.concat("_base", chosen))))
    is_new = lambda s: s["kind"] == 3
    df = df.withColumn("_ends", F.transform("_mixed", lambda s: F.when(is_new(s), F.lit(-1).cast("long")).otherwise(s["end"])))
    df = df.withColumn("_starts", F.reverse(F.transform("_mixed", lambda s: F.when(is_new(s), F.lit((1 << 62))).otherwise(s["start"]))))
    df = running(running(df, "_ends", "_before", lambda a, b: F.greatest(a, b)), "_starts", "_after", lambda a, b: F.least(a, b))
    both = F.arrays_zip(F.col("_mixed").alias("s"), F.col("_before").alias("before"), F.reverse("_after").alias("after"))
    kept = F.transform(F.filter(both, lambda x: ~is_new(x["s"]) | ((x["before"] <= x["s"]["start"]) & (x["after"] >= x["s"]["end"]))), lambda x: x["s"])
    df = df.withColumn("_all", F.when(F.size("_mixed") > 0, kept).otherwise(F.col("_base")))
    kind = F.array(*(F.lit(k) for k in KINDS))
    named = lambda c: F.transform(c, lambda s: F.struct(kind[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.select(F.col("_id").alias(id_col), named("_all").alias("spans"), named("_base").alias("base"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
