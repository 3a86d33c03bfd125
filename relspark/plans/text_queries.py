"""Queries on texts, senses and files' contents, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relspark.functions import compounds as cp, text as tx
from relspark.lexicon import materialize, new_folder
from relspark.operators import information as info, relations as rel, senses as sn, vectors as vec
from relspark.plans import driver_lexicon as dl, measures as ms, provenance as pv
from relspark.plans.taxonomy_queries import counts, rounded
from relspark.sources import corpora, lists

#: Own short stop list.
STOP = ("the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "de", "la", "le", "et", "die", "der", "und", "el", "y", "en")


def table(spark, d, name):
    return dl.table(spark, d, name)


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP], "word string")


def corpus_tokens(spark, d):
    """(doc, word) of all documents."""
    clean = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), tx.corpus_words(F.col("text")).alias("t"))
    return clean.select("doc", F.explode(tx.words(F.col("t"))).alias("word"))


def part_tokens(spark, d):
    """(doc, word) of the definitions of all parts."""
    gloss = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.explode(tx.words(tx.vector_words(gloss))).alias("word"))


def gloss_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.clean(F.col("text"))).alias("clean"))


def gloss_examples(spark, d):
    quoted = tx.examples(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(quoted).cast("long").alias("n"), F.md5(F.array_join(quoted, "|")).alias("examples"), F.md5(tx.definition(F.col("html"))).alias("definition"))


def corpus_normalise(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.corpus_words(F.col("text")).alias("words"))


def corpus_clauses(spark, d):
    """The clauses of all documents, read back from text files; a line of one mark ends each document."""
    path = new_folder(spark)
    table(spark, d, "documents").select(F.concat(F.coalesce("text", F.lit("")), F.lit("\n."))).write.option("lineSep", "\n").text(path)
    return corpora.read(spark, path, "raw").groupBy(F.md5(F.trim("block")).alias("clause")).agg(F.count("*").alias("n"))


def term_frequency(spark, d):
    return vec.term_frequencies(corpus_tokens(spark, d))


def tfidf(spark, d):
    n = table(spark, d, "documents").count()
    return vec.tf_idf(vec.term_frequencies(corpus_tokens(spark, d)), n).select("word", rounded(F.col("tfidf"), 4).alias("tfidf"))


def cooccurrence(spark, d):
    return vec.cooccurrence(part_tokens(spark, d))


def vector_prune(spark, d):
    dims, made = vec.build_vectors(part_tokens(spark, d), 1, chigh=100_000, clow=5, rhigh=100_000, rlow=10)
    return made.join(dims.select(F.col("word").alias("dim"), "tf", "df"), "dim").select("word", "dim", "cnt", "tf", "df")


def part_vectors(spark, d):
    return vec.cooccurrence(part_tokens(spark, d)).select(F.col("w1").alias("word"), F.col("w2").alias("dim"), "cnt")


def gloss_vector_norm(spark, d):
    texts = part_tokens(spark, d).select(F.col("doc").alias("key"), "word")
    return vec.norms(vec.context_vectors(texts, part_vectors(spark, d))).select("key", rounded(F.col("norm"), 4).alias("norm"))


def part_pairs(spark, d):
    return dl.pairs(spark, d).where(dl.is_part(F.col("a")) & dl.is_part(F.col("b")))


def sim_gloss(name: str, config=None):
    def run(spark, d):
        base = ms.Config(vectors=part_vectors(spark, d) if name.startswith("vector") else None)
        given = (config or (lambda c: c))(base)
        return ms.score(dl.lexicon(spark, d), materialize(part_pairs(spark, d)), name, given).select("a", "b", rounded(F.col("score"), 6).alias("score"))

    return run


def trace_lesk(spark, d):
    """The shared phrases of the definitions of all pairs of parts."""
    out = pv.provenance(dl.lexicon(spark, d), materialize(part_pairs(spark, d)), "lesk")
    return out.select("a", "b", F.array_join("phrases", "|").alias("phrases"), "score")


def trace_vector(spark, d):
    """Products and lengths of the vectors of all pairs of parts, and the words that have vectors."""
    out = pv.provenance(dl.lexicon(spark, d), materialize(part_pairs(spark, d)), "vector", ms.Config(vectors=part_vectors(spark, d)))
    whole = [F.array_join(f"words_{s}", " ").alias(f"words_{s}") for s in "ab"]
    return out.select("a", "b", "dot", *(rounded(F.col(c), 4).alias(c) for c in ("na", "nb")), *whole, rounded(F.col("score"), 6).alias("score"))


def normalized(c: ms.Config) -> ms.Config:
    from dataclasses import replace

    return replace(c, normalize=True, relations=[(["glos"], ["glos"], 1.0), (["syns"], ["syns"], 0.5)])


def two_relations(c: ms.Config) -> ms.Config:
    from dataclasses import replace

    return replace(c, relations=[(["glosexample"], ["glosexample"], 1.0), (["syns"], ["syns"], 1.0)])


def embedding_cosine(spark, d):
    """Each vector with the next by key."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return e.join(after, "vec_id").select("vec_id", rounded(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y")), 6).alias("score"))


def word_pairs_of_parts(spark, d):
    """Compounds: the pairs of words that part names consist of."""
    return table(spark, d, "part").select(F.lower(F.translate("p_name", " ", "_")).alias("word")).distinct()


def compound_tokens(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("key"), tx.words(F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand"))).alias("ws"))
    return cp.compound_tokens(docs, word_pairs_of_parts(spark, d), "key", "ws").select("key", F.col("at").cast("long").alias("at"), "token")


def compoundify(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("t"))
    return cp.compoundify(docs, "t", word_pairs_of_parts(spark, d)).select("key", "compounds")


def compoundify_join(spark, d):
    """The same by the way of dictionaries that are too large for the tasks."""
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("t"))
    return cp.compoundify(docs, "t", word_pairs_of_parts(spark, d), max_bytes=0).select("key", "compounds")


def stop_filter(spark, d):
    left = sn.drop_stop_words(corpus_tokens(spark, d), stop_words(spark))
    return left.groupBy("word").agg(F.count("*").alias("n"))


def stop_filter_compound(spark, d):
    """Neighbouring words of all documents as compounds; those of stop words only go."""
    ws = table(spark, d, "documents").select(tx.words(tx.corpus_words(F.col("text"))).alias("ws"))
    two = ws.select(F.explode(F.arrays_zip(F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 1, F.lit(0))).alias("a"), F.slice("ws", F.lit(2), F.size("ws")).alias("b"))).alias("p"))
    joined = two.select(F.concat_ws("_", "p.a", "p.b").alias("word")).distinct()
    return sn.drop_stop_compounds(joined.withColumn("key", F.col("word")), stop_words(spark), "key").select("word")


def freq_count(resnik: bool):
    """Each line item is a token, the model word of its part."""
    def run(spark, d):
        lexicon = dl.lexicon(spark, d)
        items = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
        words = table(spark, d, "part").select("p_partkey", dl.model_word().alias("word"))
        tokens = items.join(words, F.col("l_partkey") == F.col("p_partkey")).select("word", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
        forms = words.select(F.col("word").alias("form"), F.lit("n").alias("pos"), F.col("word").alias("lemma")).distinct()
        return info.count_words(tokens.select("word"), forms, lexicon.sense, resnik).select("pos", "id", rounded(F.col("freq"), 6).alias("freq"))

    return run


def super_gloss(spark, d):
    lexicon = dl.lexicon(spark, d)
    start = lexicon.synset.where("pos = 'n'").select(F.col("id").alias("key"), "pos", "id")
    return rel.compose(lexicon, ["hype", "glosexample"], start).select("key", F.array_join("texts", "|").alias("gloss"))


def nouns(spark, d):
    """(w1, w2): the models of parts in lines next to each other."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("_b"))
    words = table(spark, d, "part").select("p_partkey", dl.model_word().alias("word"))
    one = words.select(F.col("p_partkey").alias("l_partkey"), F.col("word").alias("w1"))
    two = words.select(F.col("p_partkey").alias("_b"), F.col("word").alias("w2"))
    return items.join(after, ["l_orderkey", "l_linenumber"]).join(one, "l_partkey").join(two, "_b").select("w1", "w2").distinct()


def sense_lookup(spark, d):
    """Models of parts, in three forms of asking; one form has no sense of its own and falls back on its base."""
    words = table(spark, d, "part").select(dl.model_word().alias("w")).distinct()
    asked = words.select(F.explode(F.array("w", F.concat("w", F.lit("#n")), F.concat("w", F.lit("#n#1")), F.concat("w", F.lit("s")))).alias("input"))
    forms = words.select(F.concat("w", F.lit("s")).alias("form"), F.lit("n").alias("pos"), F.col("w").alias("lemma"))
    found = sn.lookup(asked, dl.lexicon(spark, d).sense, forms)
    return found.groupBy("input").agg(F.count("*").alias("senses"), F.min("id").alias("first"), F.max("id").alias("last"))


def noun_pairs(spark, d):
    return nouns(spark, d).select(F.concat("w1", F.lit("#n")).alias("w1"), F.concat("w2", F.lit("#n")).alias("w2"))


def all_senses(spark, d):
    out = ms.score_words(dl.lexicon(spark, d), noun_pairs(spark, d), "path", all_senses=True)
    return out.select("w1", "w2", "wps1", "wps2", rounded(F.col("score")).alias("score"))


def best_sense(spark, d):
    return ms.score_words(dl.lexicon(spark, d), noun_pairs(spark, d), "path").select("w1", "w2", "wps1", "wps2", rounded(F.col("score")).alias("score"))


def rank_pairs(spark, d):
    scored = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("w1"), F.col("l_linenumber").cast("string").alias("w2"), (F.col("l_discount") * F.col("l_quantity")).alias("score"))
    return sn.rank_pairs(scored).select("w1", "w2", "score", "rank")


def made_senses(spark, d):
    """Sense strings, good and bad, of the models of all parts."""
    w = dl.model_word()
    forms = [w, F.concat(w, F.lit("#n")), F.concat(w, F.lit("#n#1")), F.concat(w, F.lit("#x#1")), F.concat(w, F.lit("#n#one")), F.concat(w, F.lit("#n#999999")), F.lit(""), F.concat(w, F.lit("#n#1#2"))]
    return table(spark, d, "part").select(F.explode(F.array(*forms)).alias("wps")).distinct()


def wps_validate(spark, d):
    out = sn.validate(made_senses(spark, d), "wps", dl.lexicon(spark, d).sense)
    return out.select("wps", "id", F.col("err_level").cast("long").alias("err_level"), sn.well_formed(F.col("wps")).alias("well_formed"))


def pair_file_parse(spark, d):
    """Lines of a pair file made from all part names, with comments and faults."""
    name = F.col("p_name")
    lines = table(spark, d, "part").select("p_partkey", F.explode(F.array(name, F.concat(name, F.lit(" // note")), F.concat(F.lit("# "), name), F.concat(name, F.lit(" more")), F.lit("//"))).alias("value"))
    return lists.word_pairs(lines).select("p_partkey", "value", "w1", "w2", "ok")


def ic_lines(spark, d):
    """Lines of an information content file."""
    return counts(spark, d).select("pos", "id", F.concat(tx.offset_pos(F.col("id"), F.col("pos")), F.lit(" "), F.col("freq").cast("long").cast("string"), F.when(F.col("is_root"), " ROOT").otherwise("")).alias("line"))


def ranking_lines(spark, d):
    return lists.ranking_lines(rank_pairs(spark, d))


QUERIES = {
    "gloss_clean": gloss_clean, "gloss_examples": gloss_examples, "corpus_normalise": corpus_normalise, "corpus_clauses": corpus_clauses, "term_frequency": term_frequency, "tfidf": tfidf,
    "cooccurrence": cooccurrence, "vector_prune": vector_prune, "gloss_vector_norm": gloss_vector_norm, "sim_vector": sim_gloss("vector"), "sim_vector_pairs": sim_gloss("vector_pairs"),
    "sim_vector_pairs_two": sim_gloss("vector_pairs", two_relations), "compoundify_join": compoundify_join,
    "trace_lesk": trace_lesk, "trace_vector": trace_vector,
    "sim_lesk": sim_gloss("lesk"), "sim_lesk_norm": sim_gloss("lesk", normalized), "embedding_cosine": embedding_cosine,
    "compound_tokens": compound_tokens, "compoundify": compoundify, "stop_filter": stop_filter, "stop_filter_compound": stop_filter_compound,
    "freq_count": freq_count(False), "freq_resnik": freq_count(True), "super_gloss": super_gloss, "sense_lookup": sense_lookup, "all_senses": all_senses, "best_sense": best_sense,
    "rank_pairs": rank_pairs, "wps_validate": wps_validate, "pair_file_parse": pair_file_parse, "ic_lines": ic_lines, "ranking_lines": ranking_lines,
}

_STOP = ", ".join(f"'{w}'" for w in STOP)


def _numbers(text: str) -> str:
    # RE2 has no look-around; a second pass joins what one-digit numbers hid from the first
    return f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({text}), '''', ''), '[^a-z0-9]+', ' ', 'g'), '([0-9]) ([0-9])', '\\1\\2', 'g'), '([0-9]) ([0-9])', '\\1\\2', 'g'))"


def _split(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda x: x <> '')"


_TOKENS = f"tokens(doc, word) AS MATERIALIZED (SELECT doc_id, unnest({_split(_numbers('text'))}) FROM documents)"
_PART = "trim(regexp_replace(replace(lower(concat_ws(' ', p_name, p_brand, p_type)), '''', ''), '[^a-z0-9]+', ' ', 'g'))"
_PARTS = f"toks(doc, word) AS MATERIALIZED (SELECT p_partkey, unnest({_split(_PART)}) FROM part), per AS (SELECT doc, word, count(*) AS n FROM toks GROUP BY doc, word), co(w1, w2, cnt) AS MATERIALIZED (SELECT x.word, y.word, sum(x.n * y.n)::BIGINT FROM per x JOIN per y USING (doc) GROUP BY x.word, y.word)"
_CTX = "ctx(key, dim, v) AS MATERIALIZED (SELECT t.doc, co.w2, sum(co.cnt)::DOUBLE FROM (SELECT DISTINCT doc, word FROM toks) t JOIN co ON co.w1 = t.word GROUP BY t.doc, co.w2)"
_PPAIRS = f"pp AS (SELECT a, b FROM pairs WHERE a BETWEEN {dl.PART} AND {dl.PART + dl.SPAN - 1} AND b BETWEEN {dl.PART} AND {dl.PART + dl.SPAN - 1})"
_COS = f"WITH {dl.SQL_PAIRS}, {_PPAIRS}, {_PARTS}, {_CTX}, nrm AS (SELECT key, sqrt(sum(v * v)) AS m FROM ctx GROUP BY key) SELECT pp.a, pp.b, round(sum(x.v * y.v) / (max(n.m) * max(o.m)), 6) + 0.0 AS score FROM pp JOIN ctx x ON x.key = pp.a - {dl.PART} JOIN ctx y ON y.key = pp.b - {dl.PART} AND y.dim = x.dim JOIN nrm n ON n.key = x.key JOIN nrm o ON o.key = y.key GROUP BY pp.a, pp.b"
_MARKS = tx.MARKS.replace("'", "''")
# Look-arounds by captures: apostrophes between word characters are kept as chr(1) while all others go; twice, as a match takes both neighbours.
_BARE = f"translate(text, '{_MARKS}', '{' ' * len(tx.MARKS)}')"
_KEPT = f"regexp_replace(regexp_replace({_BARE}, '(\\w)''(\\w)', '\\1' || chr(1) || '\\2', 'g'), '(\\w)''(\\w)', '\\1' || chr(1) || '\\2', 'g')"
_CLEAN = f"lower(trim(regexp_replace(replace(replace(replace({_KEPT}, chr(39), ' '), chr(1), chr(39)), '--', ' '), '\\s+', ' ', 'g')))"

# Phrases of each two texts, one a step: the longest, the earliest; its words become marks that match nothing.
_LONGEST = "list_max(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(b) + 1), lambda j: CASE WHEN a[i] <> b[j] THEN [0, 0, 0] ELSE [list_max(list_filter(range(1, least(len(a) - i, len(b) - j) + 2), lambda k: a[i:i + k - 1] = b[j:j + k - 1])), -i, -j] END))))"
_USED = "{t}[1:-m[{p}] - 1] || list_transform(range(m[1]), lambda x: chr(2) || '{t}') || {t}[-m[{p}] + m[1]:]"
_LESK = f"""WITH RECURSIVE {dl.SQL_PAIRS}, {_PPAIRS},
gloss AS MATERIALIZED (SELECT p_partkey + {dl.PART} AS id, {_CLEAN.replace(_BARE, _BARE.replace("text", "concat_ws(' ', p_name, p_brand, p_type)"))} AS g, p_name FROM part),
two AS MATERIALIZED (SELECT pp.a, pp.b, x.g AS ga, y.g AS gb, x.p_name AS na, y.p_name AS nb FROM pp JOIN gloss x ON x.id = pp.a JOIN gloss y ON y.id = pp.b),
texts AS MATERIALIZED (SELECT DISTINCT ga, gb, {_split('ga')} AS a, {_split('gb')} AS b FROM two),
taken(ga, gb, a, b, s, m) AS (SELECT ga, gb, a, b, 0, {_LONGEST} FROM texts
  UNION ALL SELECT ga, gb, a, b, s, {_LONGEST} FROM (SELECT ga, gb, {_USED.format(t="a", p=2)} AS a, {_USED.format(t="b", p=3)} AS b, s + m[1] * m[1] AS s FROM taken WHERE m[1] > 0)),
lesk AS (SELECT ga, gb, max(s) AS s, max(len(a)) AS na, max(len(b)) AS nb FROM taken GROUP BY ga, gb)"""
_NAME = "trim(regexp_replace(replace(lower(p_name), '''', ''), '[^a-z0-9]+', ' ', 'g'))"
_TWO = f"""WITH {dl.SQL_PAIRS}, {_PPAIRS}, {_PARTS}, own AS (SELECT 0 AS r, doc, word FROM toks UNION SELECT 1, p_partkey, unnest({_split(_NAME)}) FROM part),
ctx AS MATERIALIZED (SELECT r, doc AS key, co.w2 AS dim, sum(co.cnt)::DOUBLE AS v FROM own JOIN co ON co.w1 = own.word GROUP BY r, doc, co.w2), nrm AS (SELECT r, key, sqrt(sum(v * v)) AS m FROM ctx GROUP BY r, key),
dots AS (SELECT pp.a, pp.b, x.r, sum(x.v * y.v) AS d FROM pp JOIN ctx x ON x.key = pp.a - {dl.PART} JOIN ctx y ON y.key = pp.b - {dl.PART} AND y.dim = x.dim AND y.r = x.r GROUP BY pp.a, pp.b, x.r)
SELECT a, b, round(sum(d / (n.m * o.m)) / 2, 6) + 0.0 AS score FROM dots JOIN nrm n ON n.r = dots.r AND n.key = a - {dl.PART} JOIN nrm o ON o.r = dots.r AND o.key = b - {dl.PART} GROUP BY a, b"""
_RANKED = "ranked AS (SELECT w1, w2, score, rank() OVER (ORDER BY score DESC) AS rank FROM (SELECT l_orderkey::VARCHAR AS w1, l_linenumber::VARCHAR AS w2, round(l_discount * l_quantity, 2) AS score FROM lineitem))"
_SENSES = dl.SQL_SENSES
_NOUNS = f"models AS (SELECT p_partkey, {dl.SQL_MODEL} AS w FROM part), nouns AS (SELECT DISTINCT p.w AS w1, q.w AS w2 FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 JOIN models p ON p.p_partkey = x.l_partkey JOIN models q ON q.p_partkey = y.l_partkey)"
_SCORED = f"""WITH RECURSIVE {dl.SQL_ISA}, {dl.SQL_NODES}, {dl.SQL_PATHS}, {_SENSES}, {_NOUNS},
sp AS (SELECT n.w1 || '#n' AS w1, n.w2 || '#n' AS w2, n.w1 || '#n#' || x.sense AS wps1, n.w2 || '#n#' || y.sense AS wps2, x.id AS a, y.id AS b FROM nouns n JOIN senses x ON x.word = n.w1 JOIN senses y ON y.word = n.w2),
pairs(a, b) AS (SELECT DISTINCT a, b FROM sp), {dl.sql_met()}, len AS (SELECT a, b, min(len) AS l FROM met GROUP BY a, b),
scored AS (SELECT w1, w2, wps1, wps2, round(1.0 / l, 6) + 0.0 AS score FROM sp JOIN len USING (a, b))"""
_COUNTED = f"c AS (SELECT {dl.SQL_MODEL} AS word, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), k AS (SELECT word, count(*) AS m FROM senses GROUP BY word)"
_WPS = "wps AS (SELECT DISTINCT unnest([w, w || '#n', w || '#n#1', w || '#x#1', w || '#n#one', w || '#n#999999', '', w || '#n#1#2']) AS wps FROM (SELECT " + dl.SQL_MODEL + " AS w FROM part))"
_LINES = "lines AS (SELECT p_partkey, unnest([p_name, p_name || ' // note', '# ' || p_name, p_name || ' more', '//']) AS value FROM part), bare AS (SELECT p_partkey, value, trim(regexp_replace(regexp_replace(value, '^\\s*#.*$', ''), '//.*$', '')) AS t FROM lines)"

# All compounds have two words, so the longest one from a word on is it and the next, if listed.
_WALK = "SELECT 0 AS step, key, ws, 0 AS k, 1 + list_contains((SELECT list(DISTINCT word) FROM comp), ws[1] || '_' || coalesce(ws[2], ''))::INTEGER AS n FROM {t} WHERE len(ws) > 0 UNION ALL SELECT step + 1, key, ws, k + n, 1 + list_contains((SELECT list(DISTINCT word) FROM comp), ws[k + n + 1] || '_' || coalesce(ws[k + n + 2], ''))::INTEGER FROM {w} WHERE k + n < len(ws)"
_WALKED = f"""WITH RECURSIVE comp(word) AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) FROM part),
texts AS (SELECT p_partkey AS key, {_split("regexp_replace(lower(concat_ws(' ', p_type, p_name, p_brand)), '\\s+', ' ', 'g')")} AS ws FROM part),
bare AS (SELECT p_partkey AS key, regexp_extract_all(lower(concat_ws(' ', p_type, p_name, p_brand)), '[a-z0-9_./''-]+') AS ws FROM part),
w1 AS ({_WALK.format(t="texts", w="w1")}), w2 AS ({_WALK.format(t="bare", w="w2")}),
walked AS (SELECT key, k, array_to_string(ws[k + 1:k + n], '_') AS token FROM w1), cut AS (SELECT key, k, array_to_string(ws[k + 1:k + n], '_') AS token FROM w2)"""

ORACLE_SQL = {
    "gloss_clean": f"SELECT doc_id, md5({_CLEAN}) AS clean FROM documents",
    "corpus_normalise": f"SELECT conv_id, turn, {_numbers('text')} AS words FROM conversations",
    "trace_lesk": f"{_LESK}, told AS (SELECT ga, gb, string_agg(array_to_string(a[-m[2]:m[1] - m[2] - 1], ' '), '|' ORDER BY s) FILTER (m[1] > 0) AS phrases FROM taken GROUP BY ga, gb) SELECT t.a, t.b, coalesce(told.phrases, '') AS phrases, l.s::DOUBLE AS score FROM two t JOIN lesk l USING (ga, gb) JOIN told USING (ga, gb)",
    "trace_vector": _COS.replace("SELECT pp.a, pp.b, round(", "SELECT pp.a, pp.b, sum(x.v * y.v) AS dot, round(max(n.m), 4) + 0.0 AS na, round(max(o.m), 4) + 0.0 AS nb, (SELECT string_agg(word, ' ' ORDER BY word) FROM (SELECT DISTINCT word FROM toks WHERE doc = pp.a - %d)) AS words_a, (SELECT string_agg(word, ' ' ORDER BY word) FROM (SELECT DISTINCT word FROM toks WHERE doc = pp.b - %d)) AS words_b, round(" % (dl.PART, dl.PART)),
    "sim_lesk": f"{_LESK} SELECT t.a, t.b, l.s::DOUBLE AS score FROM two t JOIN lesk l USING (ga, gb)",
    "sim_lesk_norm": f"{_LESK} SELECT t.a, t.b, round(l.s / (l.na * l.nb)::DOUBLE + CASE WHEN t.na = t.nb THEN 0.5 ELSE 0 END, 6) + 0.0 AS score FROM two t JOIN lesk l USING (ga, gb)",
    "corpus_clauses": "SELECT md5(c) AS clause, count(*) AS n FROM (SELECT trim(unnest(string_split_regex(replace(regexp_replace(text, '\r\f?', '', 'g'), chr(10), ' '), '[.?!,;:]')), ' ') AS c FROM documents) WHERE c <> '' GROUP BY c",
    "gloss_examples": "SELECT page_id, len(x)::BIGINT AS n, md5(array_to_string(x, '|')) AS examples, md5(split_part(html, '\"', 1)) AS definition FROM (SELECT page_id, html, regexp_extract_all(html, '\"([^\"]*)\"', 1) AS x FROM pages)",
    "term_frequency": f"WITH {_TOKENS} SELECT word, count(*)::BIGINT AS tf, count(DISTINCT doc)::BIGINT AS df FROM tokens GROUP BY word",
    "tfidf": f"WITH {_TOKENS} SELECT word, round(count(*) * ln((SELECT count(*) FROM documents)::DOUBLE / count(DISTINCT doc)), 4) + 0.0 AS tfidf FROM tokens GROUP BY word",
    "cooccurrence": f"WITH {_PARTS} SELECT w1, w2, cnt FROM co",
    "vector_prune": f"WITH {_PARTS}, tf AS (SELECT word, count(*)::BIGINT AS tf, count(DISTINCT doc)::BIGINT AS df FROM toks GROUP BY word) SELECT co.w1 AS word, co.w2 AS dim, co.cnt, d.tf, d.df FROM co JOIN tf d ON d.word = co.w2 JOIN tf r ON r.word = co.w1 WHERE d.tf BETWEEN 5 AND 100000 AND r.tf BETWEEN 10 AND 100000",
    "gloss_vector_norm": f"WITH {_PARTS}, {_CTX} SELECT key, round(sqrt(sum(v * v)), 4) + 0.0 AS norm FROM ctx GROUP BY key",
    "sim_vector": _COS, "sim_vector_pairs": _COS, "sim_vector_pairs_two": _TWO,
    "embedding_cosine": "SELECT x.vec_id, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]) * list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])), 6) + 0.0 AS score FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
    "stop_filter": f"WITH {_TOKENS} SELECT word, count(*)::BIGINT AS n FROM tokens WHERE word NOT IN ({_STOP}) GROUP BY word",
    "stop_filter_compound": f"WITH w AS (SELECT {_split(_numbers('text'))} AS ws FROM documents) SELECT DISTINCT a || '_' || b AS word FROM (SELECT unnest(ws[1:len(ws) - 1]) AS a, unnest(ws[2:len(ws)]) AS b FROM w WHERE len(ws) > 1) WHERE NOT (a IN ({_STOP}) AND b IN ({_STOP}))",
    "freq_count": f"WITH {_SENSES}, {_COUNTED} SELECT 'n' AS pos, id, round(sum(n)::DOUBLE, 6) + 0.0 AS freq FROM c JOIN senses USING (word) GROUP BY id",
    "freq_resnik": f"WITH {_SENSES}, {_COUNTED} SELECT 'n' AS pos, id, round(sum(n::DOUBLE / m), 6) + 0.0 AS freq FROM c JOIN senses USING (word) JOIN k USING (word) GROUP BY id",
    "all_senses": f"{_SCORED} SELECT * FROM scored",
    "best_sense": f"{_SCORED} SELECT w1, w2, wps1, wps2, score FROM (SELECT *, row_number() OVER (PARTITION BY w1, w2 ORDER BY score DESC, wps1, wps2) AS k FROM scored) WHERE k = 1",
    "sense_lookup": f"WITH {_SENSES}, w AS (SELECT DISTINCT word FROM senses), asked AS (SELECT word AS input, word, NULL AS s FROM w UNION ALL SELECT word || '#n', word, NULL FROM w UNION ALL SELECT word || '#n#1', word, 1 FROM w UNION ALL SELECT word || 's', word, NULL FROM w) SELECT input, count(*)::BIGINT AS senses, min(id) AS first, max(id) AS last FROM asked JOIN senses USING (word) WHERE s IS NULL OR s = sense GROUP BY input",
    "rank_pairs": f"WITH {_RANKED} SELECT w1, w2, score, rank::BIGINT AS rank FROM ranked",
    "ranking_lines": f"WITH {_RANKED} SELECT w1 || '<>' || w2 || '<>' || rank || ' ' || printf('%.2f', score) || ' 0 0 0' AS line FROM ranked",
    "wps_validate": f"WITH {_SENSES}, {_WPS} SELECT wps, s.id, (CASE WHEN s.id IS NULL THEN 1 ELSE 0 END)::BIGINT AS err_level, regexp_full_match(wps, '\\S+#[nvar]#[0-9]+') AS well_formed FROM wps LEFT JOIN senses s ON regexp_full_match(wps, '[^#]+#n#[0-9]+') AND s.word || '#n#' || s.sense = wps",
    "pair_file_parse": f"WITH {_LINES} SELECT p_partkey, value, CASE WHEN len(string_split(t, ' ')) = 2 THEN split_part(t, ' ', 1) END AS w1, CASE WHEN len(string_split(t, ' ')) = 2 THEN split_part(t, ' ', 2) END AS w2, len(string_split(t, ' ')) = 2 AS ok FROM bare WHERE t <> ''",
    "compound_tokens": f"{_WALKED} SELECT key, k::BIGINT AS \"at\", token FROM walked",
    "compoundify": f"{_WALKED} SELECT key, string_agg(token, ' ' ORDER BY k) AS compounds FROM cut GROUP BY key",
    "compoundify_join": f"{_WALKED} SELECT key, string_agg(token, ' ' ORDER BY k) AS compounds FROM cut GROUP BY key",
    "super_gloss": f"WITH {dl.SQL_ISA}, g(id, gloss) AS (SELECT r_regionkey + {dl.REGION}, r_name FROM region UNION ALL SELECT n_nationkey + {dl.NATION}, n_name FROM nation UNION ALL SELECT id, v FROM {dl._rank('customer', 'c_mktsegment', dl.SEGMENT)} UNION ALL SELECT id, v FROM {dl._rank('part', 'p_type', dl.TYPE)} UNION ALL SELECT id, v FROM {dl._rank('part', 'p_brand', dl.BRAND)} UNION ALL SELECT id, v FROM {dl._rank('orders', 'o_orderpriority', dl.PRIORITY)} UNION ALL SELECT c_custkey + {dl.CUSTOMER}, c_name FROM customer) SELECT child AS key, string_agg(lower(trim(regexp_replace(gloss, '\\s+', ' ', 'g'))), '|' ORDER BY parent) AS gloss FROM (SELECT DISTINCT child, parent FROM isa WHERE pos = 'n') JOIN g ON g.id = parent GROUP BY child",
    "ic_lines": f"WITH RECURSIVE {dl.SQL_ISA}, {dl.SQL_NODES}, {dl.SQL_OWN}, {dl.SQL_COUNTS} SELECT pos, id, id || pos || ' ' || freq::BIGINT || CASE WHEN is_root THEN ' ROOT' ELSE '' END AS line FROM counts",
}
