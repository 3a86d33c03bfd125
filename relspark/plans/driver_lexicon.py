"""A lexicon over the business tables, so that every operator runs on tables of any size.

Concepts are regions, nations, market segments, part types and brands, order priorities,
customers, suppliers, parts, orders (nouns), event types and the users of each (verbs). Each
concept's parents are what it belongs to: an order has a customer and a priority, a customer a
nation and a segment, and so on. No way up has more than three links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from relspark.lexicon import Lexicon, materialize

HEIGHT = 3
#: Each kind of concepts has a range of SPAN ids, and so has each event type's users, the last kind; no two ranges meet.
SPAN = 1 << 40
REGION, NATION, SEGMENT, TYPE, BRAND, PRIORITY, EVENT, CUSTOMER, SUPPLIER, PART, ORDER, USER = (kind * SPAN for kind in range(1, 13))
USERS = SPAN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concept(base: int, key: Column) -> Column:
    """The id of a key of a kind; keys are from 0 on and below SPAN. Ids of a kind have the order of their keys."""
    return key.cast("long") + F.lit(base)


def user(event: Column, key: Column) -> Column:
    """The id of a user of an event type, which is given by its rank."""
    return event.cast("long") * F.lit(USERS) + key.cast("long") + F.lit(USER)


def is_part(concept_id: Column) -> Column:
    """For nouns."""
    return concept_id.between(PART, PART + SPAN - 1)


def ranked(df: DataFrame, column: str, base: int) -> DataFrame:
    """(value, id): the distinct values of a column of few values, numbered in their order."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    rank = F.row_number().over(Window.orderBy("value"))
    return values.select("value", (concept(base, rank) if base else rank.cast("long")).alias("id"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, id, name, gloss): all concepts."""
    t = lambda name: table(spark, sf_dir, name)
    plain = lambda df, key, base, name, gloss=None: df.select(F.lit("n").alias("pos"), concept(base, F.col(key)).alias("id"), F.col(name).alias("name"), (gloss if gloss is not None else F.col(name)).alias("gloss"))
    named = lambda df, column, base, pos="n": ranked(df, column, base).select(F.lit(pos).alias("pos"), "id", F.col("value").alias("name"), F.col("value").alias("gloss"))
    users = t("events").select("event_type", "user_id").distinct().join(ranked(t("events"), "event_type", 0).withColumnRenamed("value", "event_type"), "event_type")
    parts = [
        plain(t("region"), "r_regionkey", REGION, "r_name"), plain(t("nation"), "n_nationkey", NATION, "n_name"),
        named(t("customer"), "c_mktsegment", SEGMENT), named(t("part"), "p_type", TYPE), named(t("part"), "p_brand", BRAND), named(t("orders"), "o_orderpriority", PRIORITY),
        plain(t("customer"), "c_custkey", CUSTOMER, "c_name"), plain(t("supplier"), "s_suppkey", SUPPLIER, "s_name"),
        plain(t("part"), "p_partkey", PART, "p_name", F.concat_ws(" ", "p_name", "p_brand", "p_type")),
        t("orders").select(F.lit("n").alias("pos"), concept(ORDER, F.col("o_orderkey")).alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.concat_ws(" ", F.lit("order"), "o_orderpriority").alias("gloss")),
        named(t("events"), "event_type", EVENT, "v"),
        users.select(F.lit("v").alias("pos"), user(F.col("id"), F.col("user_id")).alias("id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("gloss")),
    ]
    return reduce(DataFrame.unionByName, parts)


def isa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, child, parent)."""
    t = lambda name: table(spark, sf_dir, name)
    link = lambda df, child, parent, pos="n": df.select(F.lit(pos).alias("pos"), child.cast("long").alias("child"), parent.cast("long").alias("parent"))
    to = lambda name, column, base: t(name).join(ranked(t(name), column, base), F.col(column) == F.col("value"))
    users = t("events").select("event_type", "user_id").distinct().join(ranked(t("events"), "event_type", 0), F.col("event_type") == F.col("value"))
    c = F.col
    parts = [
        link(t("nation"), concept(NATION, c("n_nationkey")), concept(REGION, c("n_regionkey"))),
        link(t("customer"), concept(CUSTOMER, c("c_custkey")), concept(NATION, c("c_nationkey"))), link(to("customer", "c_mktsegment", SEGMENT), concept(CUSTOMER, c("c_custkey")), c("id")),
        link(t("supplier"), concept(SUPPLIER, c("s_suppkey")), concept(NATION, c("s_nationkey"))),
        link(to("part", "p_type", TYPE), concept(PART, c("p_partkey")), c("id")), link(to("part", "p_brand", BRAND), concept(PART, c("p_partkey")), c("id")),
        link(t("orders"), concept(ORDER, c("o_orderkey")), concept(CUSTOMER, c("o_custkey"))), link(to("orders", "o_orderpriority", PRIORITY), concept(ORDER, c("o_orderkey")), c("id")),
        link(users, user(c("id"), c("user_id")), concept(EVENT, c("id")), "v"),
    ]
    return reduce(DataFrame.unionByName, parts)


def own_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, id, freq): line items of suppliers, parts and orders, events of types' users."""
    items = table(spark, sf_dir, "lineitem")
    count = lambda key, base: items.groupBy(concept(base, F.col(key)).alias("id")).agg(F.count("*").cast("double").alias("freq")).withColumn("pos", F.lit("n"))
    events = table(spark, sf_dir, "events").select("event_type", "user_id")
    users = events.join(ranked(events, "event_type", 0), F.col("event_type") == F.col("value")).groupBy(user(F.col("id"), F.col("user_id")).alias("id")).agg(F.count("*").cast("double").alias("freq")).withColumn("pos", F.lit("v"))
    return reduce(DataFrame.unionByName, [count("l_suppkey", SUPPLIER), count("l_partkey", PART), count("l_orderkey", ORDER), users]).select("pos", "id", "freq")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, src_pos, src, dst_pos, dst): is-a links both ways, and further relations of linear size.

    mero, holo: an order and the parts in it. sim: parts next to each other within their brand
    and type. attr: a part and its type. enta: an event type and the next. caus: back."""
    up = isa(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").select(concept(ORDER, F.col("l_orderkey")).alias("o"), concept(PART, F.col("l_partkey")).alias("p")).distinct()
    part = table(spark, sf_dir, "part")
    after = part.select(concept(PART, F.col("p_partkey")).alias("a"), concept(PART, F.lead("p_partkey").over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))).alias("b")).where("b is not null")
    kinds = part.join(ranked(part, "p_type", TYPE), F.col("p_type") == F.col("value")).select(concept(PART, F.col("p_partkey")).alias("p"), "id")
    events = ranked(table(spark, sf_dir, "events"), "event_type", EVENT)
    following = events.select("id", (F.col("id") + 1).alias("next")).join(events.select(F.col("id").alias("next")), "next").select("id", "next")
    one = lambda df, rel, a, b, pa=None, pb=None: df.select(F.lit(rel).alias("rel"), (pa if pa is not None else F.lit("n")).alias("src_pos"), F.col(a).alias("src"), (pb if pb is not None else F.lit("n")).alias("dst_pos"), F.col(b).alias("dst"))
    v = F.lit("v")
    return reduce(DataFrame.unionByName, [
        one(up, "hype", "child", "parent", F.col("pos"), F.col("pos")), one(up, "hypo", "parent", "child", F.col("pos"), F.col("pos")),
        one(items, "mero", "o", "p"), one(items, "holo", "p", "o"), one(after, "sim", "a", "b"), one(after, "sim", "b", "a"),
        one(kinds, "attr", "p", "id"), one(following, "enta", "id", "next", v, v), one(following, "caus", "next", "id", v, v),
    ])


def model_word() -> Column:
    return F.lower(F.concat_ws("_", F.translate("p_brand", "#", ""), "p_type", F.col("p_size").cast("string")))


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, w1, w2, p_brand, p_type): both words of each part in the lexicon with words, its model and its name."""
    return table(spark, sf_dir, "part").select(concept(PART, F.col("p_partkey")).alias("id"), model_word().alias("w1"), F.lower(F.translate("p_name", " ", "_")).alias("w2"), "p_brand", "p_type")


def named_word(name: str) -> Column:
    return F.translate(F.lower(name), " #", "_")


def word_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, src_pos, src, dst_pos, dst, src_word, dst_word), of linear size. ants: from a part's model to the name of the next part
    of its brand and type, and back. also: from a part's name to the next part's model. pert: from a part's name to
    its brand. deri: from a customer to what it does as a user of events, and back."""
    words = part_words(spark, sf_dir)
    order = Window.partitionBy("p_brand", "p_type").orderBy("id")
    near = words.select("id", "w1", "w2", F.lead("id").over(order).alias("id_b"), F.lead("w1").over(order).alias("w1_b"), F.lead("w2").over(order).alias("w2_b")).where("id_b is not null")
    after = words.select((F.col("id") - 1).alias("id"), F.col("id").alias("id_b"), F.col("w1").alias("w1_b"))
    brands = words.join(ranked(table(spark, sf_dir, "part"), "p_brand", BRAND).withColumnRenamed("id", "brand"), F.col("p_brand") == F.col("value"))
    known = nodes(spark, sf_dir).select("pos", "id", named_word("name").alias("w"))
    both = cross_pairs(spark, sf_dir).join(known.select(F.col("pos").alias("pos_a"), F.col("id").alias("a"), F.col("w").alias("wa")), ["pos_a", "a"]).join(known.select(F.col("pos").alias("pos_b"), F.col("id").alias("b"), F.col("w").alias("wb")), ["pos_b", "b"])
    n = F.lit("n")
    one = lambda df, rel, a, b, wa, wb, pa=n, pb=n: df.select(F.lit(rel).alias("rel"), pa.alias("src_pos"), F.col(a).alias("src"), pb.alias("dst_pos"), F.col(b).alias("dst"), wa.alias("src_word"), wb.alias("dst_word"))
    c = F.col
    return reduce(DataFrame.unionByName, [
        one(near, "ants", "id", "id_b", c("w1"), c("w2_b")), one(near, "ants", "id_b", "id", c("w1_b"), c("w2")),
        one(words.join(after, "id"), "also", "id", "id_b", c("w2"), c("w1_b")), one(brands, "pert", "id", "brand", c("w2"), named_word("p_brand")),
        one(both, "deri", "a", "b", c("wa"), c("wb"), c("pos_a"), c("pos_b")), one(both, "deri", "b", "a", c("wb"), c("wa"), c("pos_b"), c("pos_a")),
    ])


def worded_lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """The lexicon with a second word for each part, its name, and with relations between words."""
    plain = lexicon(spark, sf_dir)
    words = part_words(spark, sf_dir)
    second = words.select(F.col("w2").alias("word"), F.lit("n").alias("pos"), "id", F.lit(2).alias("word_no"))
    every = plain.sense.select("word", "pos", "id", "word_no").unionByName(second)
    sense = every.select("word", "pos", F.row_number().over(Window.partitionBy("word", "pos").orderBy("id", "word_no")).alias("sense"), "id", "word_no")
    synset = plain.synset.join(words.select(F.lit("n").alias("pos"), "id", F.array("w1", "w2").alias("_both")), ["pos", "id"], "left").select("pos", "id", "gloss", F.coalesce("_both", "words").alias("words"))
    return Lexicon(synset, sense, plain.edge.unionByName(word_relations(spark, sf_dir)), plain.height, plain.taxonomy)


def lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    found = nodes(spark, sf_dir)
    synset = found.select("pos", "id", "gloss", F.array("name").alias("words"))
    # A part is a sense of its model, brand, type and size, which few parts share; all else is a sense of its name.
    part = is_part(F.col("id")) & (F.col("pos") == "n")
    models = table(spark, sf_dir, "part").select(model_word().alias("word"), F.lit("n").alias("pos"), concept(PART, F.col("p_partkey")).alias("id"))
    named = found.where(~part).select(F.translate(F.lower("name"), " #", "_").alias("word"), "pos", "id")
    sense = models.unionByName(named).select("word", "pos", F.row_number().over(Window.partitionBy("word", "pos").orderBy("id")).alias("sense"), "id", F.lit(1).alias("word_no"))
    edge = relations(spark, sf_dir).withColumn("src_word", F.lit(None).cast("string")).withColumn("dst_word", F.lit(None).cast("string"))
    return Lexicon(synset, sense, edge, HEIGHT, materialize(isa(spark, sf_dir)))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos_a, a, pos_b, b), distinct."""
    return pair_rows(spark, sf_dir).distinct()


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos_a, a, pos_b, b), of linear size, over all customers, suppliers, parts, orders
    and line items: neighbours by key, parts in lines next to each other, and each line's
    customer and supplier."""
    t = lambda name: table(spark, sf_dir, name)
    near = lambda name, key, base: t(name).select(concept(base, F.col(key)).alias("a"), (F.col(key) + 1).cast("long").alias("_k")).join(t(name).select(F.col(key).cast("long").alias("_k"), concept(base, F.col(key)).alias("b")), "_k").select("a", "b")
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    after = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("_b"))
    lines = items.join(after, ["l_orderkey", "l_linenumber"]).select(concept(PART, F.col("l_partkey")).alias("a"), concept(PART, F.col("_b")).alias("b"))
    buyers = items.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(concept(CUSTOMER, F.col("o_custkey")).alias("a"), concept(SUPPLIER, F.col("l_suppkey")).alias("b"))
    every = [near("customer", "c_custkey", CUSTOMER), near("supplier", "s_suppkey", SUPPLIER), near("part", "p_partkey", PART), near("orders", "o_orderkey", ORDER), lines, buyers]
    return reduce(DataFrame.unionByName, every).select(F.lit("n").alias("pos_a"), "a", F.lit("n").alias("pos_b"), "b")


def cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos_a, a, pos_b, b): each customer that is a user of events, with the user's event types."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    known = events.join(ranked(table(spark, sf_dir, "events"), "event_type", 0), F.col("event_type") == F.col("value"))
    met = known.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("user_id") == F.col("c_custkey"))
    return met.select(F.lit("n").alias("pos_a"), concept(CUSTOMER, F.col("c_custkey")).alias("a"), F.lit("v").alias("pos_b"), user(F.col("id"), F.col("user_id")).alias("b"))


# --- the same in DuckDB -----------------------------------------------------------

_RANK = "(SELECT v, {base} + row_number() OVER (ORDER BY v) AS id FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL))"


def _rank(t: str, c: str, base: int) -> str:
    return _RANK.format(t=t, c=c, base=base)


SQL_ISA = f"""
isa(pos, child, parent) AS MATERIALIZED (
  SELECT 'n', (n_nationkey + {NATION})::BIGINT, (n_regionkey + {REGION})::BIGINT FROM nation
  UNION ALL SELECT 'n', c_custkey + {CUSTOMER}, c_nationkey + {NATION} FROM customer
  UNION ALL SELECT 'n', c_custkey + {CUSTOMER}, id FROM customer JOIN {_rank("customer", "c_mktsegment", SEGMENT)} ON c_mktsegment = v
  UNION ALL SELECT 'n', s_suppkey + {SUPPLIER}, s_nationkey + {NATION} FROM supplier
  UNION ALL SELECT 'n', p_partkey + {PART}, id FROM part JOIN {_rank("part", "p_type", TYPE)} ON p_type = v
  UNION ALL SELECT 'n', p_partkey + {PART}, id FROM part JOIN {_rank("part", "p_brand", BRAND)} ON p_brand = v
  UNION ALL SELECT 'n', o_orderkey + {ORDER}, o_custkey + {CUSTOMER} FROM orders
  UNION ALL SELECT 'n', o_orderkey + {ORDER}, id FROM orders JOIN {_rank("orders", "o_orderpriority", PRIORITY)} ON o_orderpriority = v
  UNION ALL SELECT 'v', {USER} + id * {USERS} + user_id, id + {EVENT} FROM (SELECT DISTINCT event_type, user_id FROM events) JOIN {_rank("events", "event_type", 0)} ON event_type = v)"""
SQL_NODES = """
nodes(pos, id) AS MATERIALIZED (SELECT pos, child FROM isa UNION SELECT pos, parent FROM isa)"""
SQL_PATHS = """
up(pos, id, node, path) AS (
  SELECT pos, id, id, [id] FROM nodes
  UNION ALL SELECT up.pos, up.id, isa.parent, list_append(up.path, isa.parent) FROM up JOIN isa ON isa.pos = up.pos AND isa.child = up.node),
bare(pos, id, path) AS MATERIALIZED (SELECT pos, id, path FROM up WHERE NOT EXISTS (SELECT 1 FROM isa WHERE isa.pos = up.pos AND isa.child = up.node)),
rooted(pos, id, path) AS MATERIALIZED (SELECT pos, id, list_append(path, 0) FROM bare UNION ALL SELECT DISTINCT pos, 0::BIGINT, [0::BIGINT] FROM bare)"""
SQL_OWN = f"""
own(pos, id, freq) AS MATERIALIZED (
  SELECT 'n', l_suppkey + {SUPPLIER}, count(*)::DOUBLE FROM lineitem GROUP BY l_suppkey
  UNION ALL SELECT 'n', l_partkey + {PART}, count(*) FROM lineitem GROUP BY l_partkey
  UNION ALL SELECT 'n', l_orderkey + {ORDER}, count(*) FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT 'v', {USER} + id * {USERS} + user_id, count(*) FROM events JOIN {_rank("events", "event_type", 0)} ON event_type = v GROUP BY id, user_id)"""
SQL_COUNTS = """
walks(pos, id, freq) AS (
  SELECT pos, id, freq FROM own
  UNION ALL SELECT walks.pos, isa.parent, walks.freq FROM walks JOIN isa ON isa.pos = walks.pos AND isa.child = walks.id),
counts(pos, id, freq, is_root) AS MATERIALIZED (
  SELECT n.pos, n.id, coalesce(sum(w.freq), 0)::DOUBLE, NOT EXISTS (SELECT 1 FROM isa WHERE isa.pos = n.pos AND isa.child = n.id)
  FROM nodes n LEFT JOIN walks w ON w.pos = n.pos AND w.id = n.id GROUP BY n.pos, n.id),
roots(pos, r) AS (SELECT pos, sum(freq) FROM counts WHERE is_root GROUP BY pos),
info(pos, id, freq, ic, r) AS MATERIALIZED (
  SELECT pos, id, freq, CASE WHEN freq > 0 THEN -ln(freq / r) + 0.0 ELSE 0.0 END, r FROM counts JOIN roots USING (pos)
  UNION ALL SELECT pos, 0, r, 0.0, r FROM roots)"""
SQL_PAIRS = f"""
pairs(a, b) AS MATERIALIZED (
  SELECT x.c_custkey + {CUSTOMER}, y.c_custkey + {CUSTOMER} FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1
  UNION SELECT x.s_suppkey + {SUPPLIER}, y.s_suppkey + {SUPPLIER} FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1
  UNION SELECT x.p_partkey + {PART}, y.p_partkey + {PART} FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1
  UNION SELECT x.o_orderkey + {ORDER}, y.o_orderkey + {ORDER} FROM orders x JOIN orders y ON y.o_orderkey = x.o_orderkey + 1
  UNION SELECT x.l_partkey + {PART}, y.l_partkey + {PART} FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
  UNION SELECT o_custkey + {CUSTOMER}, l_suppkey + {SUPPLIER} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SQL_MODEL = "lower(concat_ws('_', replace(p_brand, '#', ''), p_type, p_size::VARCHAR))"
SQL_SENSES = f"""
senses(word, id, sense) AS MATERIALIZED (SELECT {SQL_MODEL}, p_partkey + {PART}, row_number() OVER (PARTITION BY {SQL_MODEL} ORDER BY p_partkey) FROM part)"""


SQL_WORDS = f"""
pw AS MATERIALIZED (SELECT p_partkey + {PART} AS id, {SQL_MODEL} AS w1, lower(replace(p_name, ' ', '_')) AS w2, p_brand, p_type FROM part),
near AS (SELECT id, w1, w2, lead(id) OVER o AS id_b, lead(w1) OVER o AS w1_b, lead(w2) OVER o AS w2_b FROM pw WINDOW o AS (PARTITION BY p_brand, p_type ORDER BY id)),
does AS (SELECT c_custkey + {CUSTOMER} AS a, {USER} + id * {USERS} + user_id AS b, lower(replace(c_name, '#', '')) AS wa, lower(replace(event_type || '_' || user_id, ' ', '_')) AS wb
  FROM (SELECT DISTINCT event_type, user_id FROM events) JOIN {_rank("events", "event_type", 0)} ON event_type = v JOIN customer ON c_custkey = user_id),
words(rel, src_pos, src, dst_pos, dst, src_word, dst_word) AS MATERIALIZED (
  SELECT 'ants', 'n', id, 'n', id_b, w1, w2_b FROM near WHERE id_b IS NOT NULL UNION ALL SELECT 'ants', 'n', id_b, 'n', id, w1_b, w2 FROM near WHERE id_b IS NOT NULL
  UNION ALL SELECT 'also', 'n', x.id, 'n', y.id, x.w2, y.w1 FROM pw x JOIN pw y ON y.id = x.id + 1
  UNION ALL SELECT 'pert', 'n', pw.id, 'n', r.id, w2, lower(replace(replace(p_brand, ' ', '_'), '#', '')) FROM pw JOIN {_rank("part", "p_brand", BRAND)} r ON p_brand = v
  UNION ALL SELECT 'deri', 'n', a, 'v', b, wa, wb FROM does UNION ALL SELECT 'deri', 'v', b, 'n', a, wb, wa FROM does)"""


def sql_met(paths: str = "rooted") -> str:
    """met(a, b, s, len): candidates of each pair of paths."""
    return f"""
met(a, b, s, len, pa, pb) AS MATERIALIZED (
  SELECT a, b, s, list_position(pa, s) + list_position(pb, s) - 1, pa, pb FROM (
    SELECT p.a, p.b, x.path AS pa, y.path AS pb, list_filter(y.path, lambda v: list_contains(x.path, v))[1] AS s
    FROM pairs p JOIN {paths} x ON x.pos = 'n' AND x.id = p.a JOIN {paths} y ON y.pos = 'n' AND y.id = p.b) WHERE s IS NOT NULL)"""
