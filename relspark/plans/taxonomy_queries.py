"""Queries on the taxonomy, the measures on it and frequencies, with their DuckDB equivalents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relspark.lexicon import materialize, new_folder
from relspark.operators import information as info, paths as pt, relations as rel, walks
from relspark.plans import driver_lexicon as dl, measures as ms, provenance as pv
from relspark.plans.cache import ScoreCache
from relspark.plans.driver_lexicon import SQL_COUNTS, SQL_ISA, SQL_NODES, SQL_OWN, SQL_PAIRS, SQL_PATHS, sql_met

HEIGHT = dl.HEIGHT


def text_path(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ">")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def taxonomy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The is-a links, written, and the concepts (pos, id) that they name."""
    e = materialize(dl.isa(spark, d))
    return e, e.select("pos", F.col("child").alias("id")).unionByName(e.select("pos", F.col("parent").alias("id"))).distinct()


def n_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dl.pairs(spark, d).select(F.col("pos_a").alias("pos"), "a", "b")


def all_paths_of(spark: SparkSession, d: str, root_node: bool = True) -> DataFrame:
    isa, nodes = taxonomy(spark, d)
    return pt.root_paths(isa, nodes, root_node, HEIGHT)


def isa_closure(spark, d):
    up = all_paths_of(spark, d, False).select("pos", "id", F.posexplode("path").alias("steps", "ancestor"))
    return up.groupBy("pos", "id", "ancestor").agg(F.min("steps").cast("long").alias("distance"))


def root_paths(spark, d):
    return all_paths_of(spark, d).select("pos", "id", text_path("path").alias("path"))


def synset_depths(spark, d):
    return pt.depths_and_roots(all_paths_of(spark, d, False), False).select("pos", "id", F.col("depth").cast("long").alias("depth"), "root")


def first_depths(order: str):
    def run(spark, d):
        return pt.synset_depth(all_paths_of(spark, d), order, True).select("pos", "id", F.col("depth").cast("long").alias("depth"))

    return run


def taxonomy_depth(spark, d):
    isa, nodes = taxonomy(spark, d)
    out = pt.taxonomy_depths(nodes, isa, True, HEIGHT)
    return out.select("pos", "root", F.col("depth").cast("long").alias("depth"))


def top_nodes(spark, d):
    isa, nodes = taxonomy(spark, d)
    return pt.top_nodes(nodes, isa)


def leaf_nodes(spark, d):
    isa, nodes = taxonomy(spark, d)
    return pt.leaf_nodes(nodes, isa)


def taxonomies(spark, d):
    return pt.taxonomies(all_paths_of(spark, d, False))


def pairs_and_paths(spark, d, root_node=True):
    """The noun pairs and the paths of their concepts, both written."""
    p = materialize(n_pairs(spark, d))
    return p, materialize(pt.root_paths(taxonomy(spark, d)[0], ms.ends(p), root_node, HEIGHT))


def shortest_path_pairs(spark, d):
    return pt.path_lengths(*pairs_and_paths(spark, d)).select("a", "b", F.col("len").cast("long").alias("len"))


def all_paths_pairs(spark, d):
    return pt.all_paths(*pairs_and_paths(spark, d)).select("a", "b", "subsumer", F.col("len").cast("long").alias("len"), text_path("nodes").alias("nodes"))


def lcs_by_path(spark, d):
    return pt.lcs_by_path(*pairs_and_paths(spark, d)).select("a", "b", "subsumer", F.col("len").cast("long").alias("len"))


def lcs_by_depth(spark, d):
    pairs, paths = pairs_and_paths(spark, d)
    return pt.joint_nodes(pairs, paths, "deepest").select("a", "b", "subsumer", F.col("depth").cast("long").alias("depth"))


def counts(spark, d):
    isa, nodes = taxonomy(spark, d)
    return materialize(info.propagate(dl.own_frequencies(spark, d), nodes, isa, HEIGHT))


def lcs_by_ic(spark, d):
    known, pairs = counts(spark, d), materialize(dl.pairs(spark, d))
    ways = pt.counted_ways(taxonomy(spark, d)[0], ms.row_ends(pairs), known, HEIGHT)
    out = pt.informed_in_row(pairs, ways, info.root_frequency(known), True)
    return out.select("a", "b", "subsumer", rounded(info.ic_of(info.share_of(F.col("freq_l"), F.col("root_freq")))).alias("ic"))


def freq_propagate(spark, d):
    return counts(spark, d)


def freq_add1(spark, d):
    isa, nodes = taxonomy(spark, d)
    return info.propagate(info.add_one(dl.own_frequencies(spark, d), nodes), nodes, isa, HEIGHT)


def root_freq(spark, d):
    return info.root_frequency(counts(spark, d))


def ic_table(spark, d):
    return info.information(counts(spark, d)).select("pos", "id", "freq", rounded(F.col("prob"), 9).alias("prob"), rounded(F.col("ic")).alias("ic"))


def sim(name: str, root_node: bool = True):
    def run(spark: SparkSession, d: str) -> DataFrame:
        config = ms.Config(root_node=root_node, counts=counts(spark, d) if name in ("res", "lin", "jcn") else None)
        pairs = dl.pairs(spark, d)
        # What is scored in the pair's row is written by `score`.
        out = ms.score(dl.lexicon(spark, d), pairs if ms.MEASURES[name].in_row else materialize(pairs), name, config)
        return out.select("a", "b", rounded(F.col("score")).alias("score"), F.col("err_level").cast("long").alias("err_level"))

    return run


def score_cache(spark, d):
    """The pairs of parts, then all pairs, through a table of scores: the second run scores only what the first has not."""
    lexicon, pairs = dl.lexicon(spark, d), materialize(dl.pairs(spark, d))
    config = ms.Config(cache=ScoreCache(new_folder(spark)))
    ms.score(lexicon, pairs.where(dl.is_part(F.col("a"))), "path", config)
    out = ms.score(lexicon, pairs, "path", config)
    return out.select("a", "b", rounded(F.col("score")).alias("score"), F.col("err_level").cast("long").alias("err_level"))


def sim_cross_pos(spark, d):
    out = ms.score(dl.lexicon(spark, d), dl.cross_pairs(spark, d), "path")
    return out.select("pos_a", "a", "pos_b", "b", "score", F.col("err_level").cast("long").alias("err_level"), "err_msg")


def sim_random(spark, d):
    return ms.score(dl.lexicon(spark, d), dl.pairs(spark, d), "random").select("a", "b", "score")


def relation(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        lexicon = dl.lexicon(spark, d)
        start = lexicon.synset.select(F.col("id").alias("key"), "pos", "id")
        return rel.expand(lexicon, name, start).select("key", "pos", "id")

    return run


def rel_compose(spark, d):
    lexicon = dl.lexicon(spark, d)
    start = lexicon.synset.select(F.col("id").alias("key"), "pos", "id")
    return rel.expand(lexicon, "sim", rel.expand(lexicon, "mero", start))


def word_relation(name: str):
    """From each word of each concept the words that it is related to."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        lexicon = dl.worded_lexicon(spark, d)
        start = lexicon.sense.select(F.concat_ws(":", F.col("id").cast("string"), "word").alias("key"), "pos", "id", "word").distinct()
        return rel.expand(lexicon, name, start).select("key", "pos", "id", "word")

    return run


def rel_compose_words(spark, d):
    """also(ants), from first words: the second step goes on from the word that the first has reached."""
    lexicon = dl.worded_lexicon(spark, d)
    start = lexicon.synset.select(F.col("id").alias("key"), "pos", "id")
    return rel.expand(lexicon, "also", rel.expand(lexicon, "ants", start)).select("key", "pos", "id", "word")


def hso_links_words(spark, d):
    lexicon = dl.worded_lexicon(spark, d)
    return walks.links(lexicon.edge, lexicon.sense)


def hso_links(spark, d):
    lexicon = dl.lexicon(spark, d)
    return walks.links(lexicon.edge, lexicon.sense)


def hso_pairs(spark, d):
    """The pairs, and each order with the parts in it and each part with its next of kind; within: whether the name of one contains the other's."""
    names = dl.nodes(spark, d).select("pos", "id", "name")
    e = dl.relations(spark, d).where("rel in ('mero', 'sim', 'hypo')").select(F.col("src_pos").alias("pos_a"), F.col("src").alias("a"), F.col("dst_pos").alias("pos_b"), F.col("dst").alias("b"))
    every = dl.pair_rows(spark, d).unionByName(e).distinct()
    one = names.select(F.col("pos").alias("pos_a"), F.col("id").alias("a"), F.col("name").alias("word_a"))
    two = names.select(F.col("pos").alias("pos_b"), F.col("id").alias("b"), F.col("name").alias("word_b"))
    both = every.join(one, ["pos_a", "a"]).join(two, ["pos_b", "b"])
    return both.select("pos_a", "a", "pos_b", "b", (F.col("word_a").contains(F.col("word_b")) | F.col("word_b").contains(F.col("word_a"))).alias("within"))


def sim_hso(spark, d):
    return ms.score(dl.lexicon(spark, d), hso_pairs(spark, d), "hso").select("pos_a", "a", "pos_b", "b", "score")


def trace_of(name: str, *columns: str):
    """What the scores of all pairs are made of, and the scores as worked out from it."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        config = ms.Config(counts=counts(spark, d) if name == "lin" else None)
        # `lin` and `lch` read their pairs, which are distinct, once.
        out = pv.provenance(dl.lexicon(spark, d), dl.pairs(spark, d) if name in ("lin", "lch") else materialize(dl.pairs(spark, d)), name, config)
        ints = [F.col(c).cast("long").alias(c) for c in columns if not c.startswith("ic_")]
        return out.select("a", "b", *ints, *(rounded(F.col(c)).alias(c) for c in columns if c.startswith("ic_")), rounded(F.col("score")).alias("score"))

    return run


def trace_hso(spark, d):
    """Kinds and walks of all pairs: the score as worked out from the walk, and how many of its links are none."""
    lexicon = dl.lexicon(spark, d)
    lexicon = replace(lexicon, edge=materialize(lexicon.edge))
    out = materialize(pv.provenance(lexicon, hso_pairs(spark, d), "hso"))
    keys = ["pos_a", "a", "pos_b", "b"]
    before = F.concat(F.array(F.struct(F.lit("").alias("dir"), F.col("pos_a").alias("pos"), F.col("a").alias("id"))), F.slice("way", F.lit(1), F.size("way") - 1))
    step = F.explode(F.arrays_zip(before.alias("f"), F.col("way").alias("t"))).alias("s")
    told = lambda *more: out.where("way is not null").select(*more, step).select(*more, F.col("s.t.dir").alias("dir"), F.col("s.f.pos").alias("src_pos"), F.col("s.f.id").alias("src"), F.col("s.t.pos").alias("dst_pos"), F.col("s.t.id").alias("dst"))
    # Links that many walks tell are looked up once; walks are looked through again only if a link is none.
    link = ["dir", "src_pos", "src", "dst_pos", "dst"]
    none = materialize(told().distinct().join(walks.links(lexicon.edge, lexicon.sense), link, "left_anti"))
    astray = F.when(F.col("way").isNotNull() & ((F.element_at("way", -1)["id"] != F.col("b")) | (F.element_at("way", -1)["pos"] != F.col("pos_b"))), 1).otherwise(0)
    n_bad = F.lit(0)
    if not none.isEmpty():
        out = out.join(told(*keys).join(none, link).groupBy(keys).agg(F.count("*").alias("n_bad")), keys, "left")
        n_bad = F.coalesce("n_bad", F.lit(0))
    return out.select(*keys, "kind", "score", (n_bad + astray).cast("long").alias("n_bad"))


QUERIES = {
    "isa_closure": isa_closure, "root_paths": root_paths, "synset_depths": synset_depths, "first_depth_numeric": first_depths("numeric"), "first_depth_lexical": first_depths("lexical"),
    "taxonomy_depth": taxonomy_depth, "top_nodes": top_nodes, "leaf_nodes": leaf_nodes, "taxonomies": taxonomies,
    "shortest_path_pairs": shortest_path_pairs, "all_paths_pairs": all_paths_pairs, "lcs_by_path": lcs_by_path, "lcs_by_depth": lcs_by_depth, "lcs_by_ic": lcs_by_ic,
    "freq_propagate": freq_propagate, "freq_add1": freq_add1, "root_freq": root_freq, "ic_table": ic_table,
    **{f"sim_{m}": sim(m) for m in ("path", "lch", "wup", "res", "lin", "jcn")}, **{f"sim_{m}_noroot": sim(m, False) for m in ("path", "lch", "wup", "res", "lin", "jcn")},
    "sim_cross_pos": sim_cross_pos, "sim_random": sim_random, **{f"rel_{r}": relation(r) for r in ("hype", "hypo", "mero", "holo", "sim", "attr", "enta", "caus")},
    "trace_lch": trace_of("lch", "subsumer", "len", "depth"), "trace_wup": trace_of("wup", "subsumer", "depth", "la", "lb"),
    "trace_lin": trace_of("lin", *pv.INFORMED), "trace_hso": trace_hso,
    "score_cache": score_cache, "rel_compose": rel_compose, "hso_links": hso_links, "sim_hso": sim_hso,
    **{f"rel_{r}": word_relation(r) for r in ("also", "ants", "pert", "deri")}, "rel_compose_words": rel_compose_words, "hso_links_words": hso_links_words,
}

_BASE = f"WITH RECURSIVE {SQL_ISA}, {SQL_NODES}, {SQL_PATHS}"
_PAIRS = f"{_BASE}, {SQL_PAIRS}, {sql_met()}"
_COUNTS = f"{SQL_OWN}, {SQL_COUNTS}"
_JOIN = "array_to_string(list_transform({}, lambda x: x::VARCHAR), '>')"


def _freq_sql(own: str) -> str:
    return f"WITH RECURSIVE {SQL_ISA}, {SQL_NODES}, {own}, {SQL_COUNTS} SELECT pos, id, freq, is_root FROM counts"


_ADD1 = f"{SQL_OWN.replace('own(', 'own0(', 1)}, own(pos, id, freq) AS (SELECT n.pos, n.id, coalesce(sum(o.freq), 0) + 1 FROM nodes n LEFT JOIN own0 o ON o.pos = n.pos AND o.id = n.id GROUP BY n.pos, n.id)"
#: For each pair: rl (subsumer's information), ra, rb, frequencies and the root's.
_INFORMED = "inf AS (SELECT m.a, m.b, max(coalesce(i.ic, 0.0)) AS l, max(coalesce(x.ic, 0.0)) AS ia, max(coalesce(y.ic, 0.0)) AS ib, arg_max(i.freq, (coalesce(i.ic, 0.0), -m.s)) AS fl, max(x.freq) AS fa, max(y.freq) AS fb, max(x.r) AS r FROM met m LEFT JOIN info i ON i.pos = 'n' AND i.id = m.s LEFT JOIN info x ON x.pos = 'n' AND x.id = m.a LEFT JOIN info y ON y.pos = 'n' AND y.id = m.b GROUP BY m.a, m.b)"
_FORMULA = {
    "res": "l",
    "lin": "CASE WHEN ia = 0 OR ib = 0 THEN 0 ELSE 2 * l / (ia + ib) END",
    "jcn": "CASE WHEN r = 0 OR ia = 0 OR ib = 0 THEN 0 WHEN fa = fl AND fb = fl THEN 1 / -ln((r - 0.01) / r) ELSE 1 / (ia + ib - 2 * l) END",
}


_TOPS = "tops(pos, root, depth) AS (SELECT pos, root, max(depth) FROM (SELECT pos, id, arg_min(path[-1], (len(path), path[-1])) AS root, min(len(path)) AS depth FROM bare b WHERE NOT EXISTS (SELECT 1 FROM isa WHERE isa.pos = b.pos AND isa.parent = b.id) GROUP BY pos, id) GROUP BY pos, root)"


def _deep_sql(paths: str) -> str:
    """cand: the deepest subsumers; far: nodes on the shortest ways to them."""
    return f"""
        deep AS (SELECT id, min(len(path)) AS d FROM {paths} WHERE pos = 'n' GROUP BY id),
        cand AS (SELECT a, b, s, d FROM (SELECT a, b, s, d, rank() OVER (PARTITION BY a, b ORDER BY d DESC) AS k FROM (SELECT DISTINCT a, b, s FROM met) JOIN deep ON deep.id = s) WHERE k = 1),
        need AS (SELECT a AS x, s FROM cand UNION SELECT b, s FROM cand),
        far AS MATERIALIZED (SELECT x, s, min(list_position(p, v) + list_position(q, v) - 1) AS l FROM (SELECT n.x, n.s, g.path AS p, h.path AS q, list_filter(h.path, lambda v: list_contains(g.path, v))[1] AS v FROM need n JOIN {paths} g ON g.pos = 'n' AND g.id = n.x JOIN {paths} h ON h.pos = 'n' AND h.id = n.s) WHERE v IS NOT NULL GROUP BY x, s)"""


def _sim_sql(name: str, root: bool) -> str:
    paths = "rooted" if root else "bare"
    head = f"{_BASE}, {SQL_PAIRS}, {sql_met(paths)}"
    if name == "path":
        scored = "scored AS (SELECT a, b, 1.0 / min(len) AS s FROM met GROUP BY a, b)"
    elif name == "lch":
        top = _TOPS
        if root:
            scored = f"{top}, scored AS (SELECT a, b, ln(2.0 * (SELECT max(depth) + 1 FROM tops WHERE pos = 'n') / min(len)) AS s FROM met GROUP BY a, b)"
        else:
            scored = f"{top}, short AS (SELECT a, b, s, len FROM (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY len) AS k FROM met) WHERE k = 1), scored AS (SELECT a, b, ln(2.0 * max(t.depth) / min(len)) AS s FROM short JOIN bare ON bare.pos = 'n' AND bare.id = short.s JOIN tops t ON t.pos = 'n' AND t.root = bare.path[-1] GROUP BY a, b)"
    elif name == "wup":
        scored = f"""{_deep_sql(paths)},
        scored AS (SELECT c.a, c.b, max(2.0 * d / (d + f.l - 1 + d + g.l - 1)) AS s FROM cand c JOIN far f ON f.x = c.a AND f.s = c.s JOIN far g ON g.x = c.b AND g.s = c.s GROUP BY c.a, c.b)"""
    else:
        scored = f"{_COUNTS}, {_INFORMED}, scored AS (SELECT a, b, {_FORMULA[name]} AS s FROM inf)"
    return f"{head}, {scored} SELECT p.a, p.b, CASE WHEN s.s IS NULL THEN -1000000.0 ELSE round(s.s, 6) + 0.0 END::DOUBLE AS score, (CASE WHEN s.s IS NULL THEN 1 ELSE 0 END)::BIGINT AS err_level FROM pairs p LEFT JOIN scored s ON s.a = p.a AND s.b = p.b"


_REL = f"""
parts AS (SELECT p_partkey + {dl.PART} AS a, lead(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) + {dl.PART} AS b FROM part),
kinds AS (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM {dl._rank("events", "event_type", dl.EVENT)}),
rels(rel, src_pos, src, dst_pos, dst) AS MATERIALIZED (
  SELECT 'hype', pos, child, pos, parent FROM isa UNION ALL SELECT 'hypo', pos, parent, pos, child FROM isa
  UNION ALL SELECT DISTINCT 'mero', 'n', l_orderkey + {dl.ORDER}, 'n', l_partkey + {dl.PART} FROM lineitem UNION ALL SELECT DISTINCT 'holo', 'n', l_partkey + {dl.PART}, 'n', l_orderkey + {dl.ORDER} FROM lineitem
  UNION ALL SELECT 'sim', 'n', a, 'n', b FROM parts WHERE b IS NOT NULL UNION ALL SELECT 'sim', 'n', b, 'n', a FROM parts WHERE b IS NOT NULL
  UNION ALL SELECT 'attr', 'n', p_partkey + {dl.PART}, 'n', id FROM part JOIN {dl._rank("part", "p_type", dl.TYPE)} ON p_type = v
  UNION ALL SELECT 'enta', 'v', id, 'v', nxt FROM kinds WHERE nxt IS NOT NULL UNION ALL SELECT 'caus', 'v', nxt, 'v', id FROM kinds WHERE nxt IS NOT NULL)"""
_RELS = f"WITH RECURSIVE {SQL_ISA}, {_REL}"
_NAMES = f"""names(pos, id, name) AS MATERIALIZED (
  SELECT 'n', r_regionkey + {dl.REGION}, r_name FROM region UNION ALL SELECT 'n', n_nationkey + {dl.NATION}, n_name FROM nation
  UNION ALL SELECT 'n', id, v FROM {dl._rank("customer", "c_mktsegment", dl.SEGMENT)} UNION ALL SELECT 'n', id, v FROM {dl._rank("part", "p_type", dl.TYPE)}
  UNION ALL SELECT 'n', id, v FROM {dl._rank("part", "p_brand", dl.BRAND)} UNION ALL SELECT 'n', id, v FROM {dl._rank("orders", "o_orderpriority", dl.PRIORITY)}
  UNION ALL SELECT 'n', c_custkey + {dl.CUSTOMER}, c_name FROM customer UNION ALL SELECT 'n', s_suppkey + {dl.SUPPLIER}, s_name FROM supplier
  UNION ALL SELECT 'n', p_partkey + {dl.PART}, p_name FROM part UNION ALL SELECT 'n', o_orderkey + {dl.ORDER}, 'order ' || o_orderkey FROM orders
  UNION ALL SELECT 'v', id, v FROM {dl._rank("events", "event_type", dl.EVENT)}
  UNION ALL SELECT DISTINCT 'v', {dl.USER} + id * {dl.USERS} + user_id, event_type || ' ' || user_id FROM events JOIN {dl._rank("events", "event_type", 0)} ON event_type = v)"""
_LINKS = "links AS MATERIALIZED (SELECT DISTINCT CASE WHEN rel IN ('sim', 'attr') THEN 'H' WHEN rel IN ('hype', 'mero') THEN 'U' ELSE 'D' END AS dir, src_pos, src, dst_pos, dst FROM rels)"
#: Walks from each end, as transitions of states (concept, links of the first kind, links of the second), then their meetings.
_HSO = f"""{_RELS}, {SQL_PAIRS}, {_NAMES}, {_LINKS},
pp(pos_a, a, pos_b, b) AS (SELECT 'n', a, 'n', b FROM pairs UNION SELECT src_pos, src, dst_pos, dst FROM rels WHERE rel IN ('mero', 'sim', 'hypo')),
named AS MATERIALIZED (SELECT pp.*, x.name AS wa, y.name AS wb FROM pp JOIN names x ON x.pos = pos_a AND x.id = a JOIN names y ON y.pos = pos_b AND y.id = b),
fwd(sp, s, p, i, u, h) AS (
  SELECT DISTINCT pos_a, a, pos_a, a, 0, 0 FROM named
  UNION SELECT f.sp, f.s, l.dst_pos, l.dst, f.u + (l.dir = 'U')::INTEGER, f.h + (l.dir = 'H')::INTEGER
  FROM fwd f JOIN links l ON l.src_pos = f.p AND l.src = f.i WHERE f.u + f.h < 5 AND (l.dir = 'H' OR (l.dir = 'U' AND f.h = 0))),
bwd(sp, s, p, i, h, d) AS (
  SELECT DISTINCT pos_b, b, pos_b, b, 0, 0 FROM named
  UNION SELECT f.sp, f.s, l.src_pos, l.src, f.h + (l.dir = 'H')::INTEGER, f.d + (l.dir = 'D')::INTEGER
  FROM bwd f JOIN links l ON l.dst_pos = f.p AND l.dst = f.i WHERE f.h + f.d < 5 AND (l.dir = 'D' OR (l.dir = 'H' AND f.d = 0))),
walked AS (
  SELECT n.pos_a, n.a, n.pos_b, n.b, 8 - f.u - f.h - g.d - CASE WHEN f.u > 0 AND f.h > 0 AND g.d > 0 THEN CASE WHEN g.d = 1 THEN 2 ELSE 1 END
    WHEN f.u > 0 AND (f.h > 0 OR g.d > 0) THEN 1 WHEN f.h > 0 AND g.d >= 2 THEN 1 ELSE 0 END AS score
  FROM named n JOIN fwd f ON f.sp = n.pos_a AND f.s = n.a JOIN bwd g ON g.sp = n.pos_b AND g.s = n.b AND g.p = f.p AND g.i = f.i
  WHERE g.h = 0 AND f.u + f.h + g.d BETWEEN 2 AND 5
  UNION ALL SELECT n.pos_a, n.a, n.pos_b, n.b, 8 - g.h - g.d - CASE WHEN g.h >= 2 THEN 1 ELSE 0 END
  FROM named n JOIN bwd g ON g.sp = n.pos_b AND g.s = n.b AND g.p = n.pos_a AND g.i = n.a WHERE g.h > 0 AND g.d > 0),
best AS (SELECT pos_a, a, pos_b, b, max(score) AS score FROM walked GROUP BY ALL)
SELECT n.pos_a, n.a, n.pos_b, n.b, (CASE WHEN n.pos_a = n.pos_b AND n.a = n.b
  OR EXISTS (SELECT 1 FROM links l WHERE l.dir = 'H' AND l.src_pos = n.pos_b AND l.src = n.b AND l.dst_pos = n.pos_a AND l.dst = n.a)
  OR EXISTS (SELECT 1 FROM links l WHERE l.dir = 'H' AND l.src_pos = n.pos_a AND l.src = n.a AND l.dst_pos = n.pos_b AND l.dst = n.b)
  OR ((contains(n.wa, n.wb) OR contains(n.wb, n.wa)) AND EXISTS (SELECT 1 FROM links l WHERE l.dir <> 'H' AND l.src_pos = n.pos_b AND l.src = n.b AND l.dst_pos = n.pos_a AND l.dst = n.a))
  THEN 16 ELSE coalesce(best.score, 0) END)::DOUBLE AS score
FROM named n LEFT JOIN best ON best.pos_a = n.pos_a AND best.a = n.a AND best.pos_b = n.pos_b AND best.b = n.b"""

_KIND = """CASE WHEN n.pos_a = n.pos_b AND n.a = n.b THEN '1 same concept'
  WHEN EXISTS (SELECT 1 FROM links l WHERE l.dir = 'H' AND l.src_pos = n.pos_a AND l.src = n.a AND l.dst_pos = n.pos_b AND l.dst = n.b) THEN '2 horizontal link'
  WHEN EXISTS (SELECT 1 FROM links l WHERE l.dir = 'H' AND l.src_pos = n.pos_b AND l.src = n.b AND l.dst_pos = n.pos_a AND l.dst = n.a) THEN '3 horizontal link back'
  WHEN (contains(n.wa, n.wb) OR contains(n.wb, n.wa)) AND EXISTS (SELECT 1 FROM links l WHERE l.dir <> 'H' AND l.src_pos = n.pos_b AND l.src = n.b AND l.dst_pos = n.pos_a AND l.dst = n.a) THEN '4 word within, link back'
  WHEN best.score IS NOT NULL THEN '5 walk' ELSE '6 none' END"""
_TRACED = _INFORMED.replace("max(coalesce(i.ic, 0.0)) AS l,", "max(coalesce(i.ic, 0.0)) AS l, arg_max(m.s, (coalesce(i.ic, 0.0), -m.s)) AS sub,")

ORACLE_SQL = {
    "isa_closure": f"{_BASE} SELECT pos, id, ancestor, min(k)::BIGINT AS distance FROM (SELECT pos, id, unnest(path) AS ancestor, unnest(range(len(path))) AS k FROM bare) GROUP BY pos, id, ancestor",
    "root_paths": f"{_BASE} SELECT pos, id, {_JOIN.format('path')} AS path FROM rooted WHERE id <> 0",
    "synset_depths": f"{_BASE} SELECT DISTINCT pos, id, len(path)::BIGINT AS depth, path[-1] AS root FROM bare",
    "first_depth_numeric": f"{_BASE} SELECT pos, id, min(len(path))::BIGINT AS depth FROM rooted WHERE id <> 0 GROUP BY pos, id",
    "first_depth_lexical": f"{_BASE} SELECT pos, id, (split_part(min((len(path))::VARCHAR || ':' || lpad(path[-1]::VARCHAR, greatest(8, length(path[-1]::VARCHAR))::INTEGER, '0')), ':', 1)::BIGINT + 1) AS depth FROM bare GROUP BY pos, id",
    "taxonomy_depth": f"{_BASE}, tops(pos, root, depth) AS (SELECT pos, root, max(depth) FROM (SELECT pos, id, arg_min(path[-1], (len(path), path[-1])) AS root, min(len(path)) AS depth FROM bare b WHERE NOT EXISTS (SELECT 1 FROM isa WHERE isa.pos = b.pos AND isa.parent = b.id) GROUP BY pos, id) GROUP BY pos, root) SELECT pos, root, depth::BIGINT AS depth FROM tops UNION ALL SELECT pos, 0, max(depth)::BIGINT + 1 FROM tops GROUP BY pos",
    "top_nodes": f"{_BASE} SELECT pos, id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM isa WHERE isa.pos = n.pos AND isa.child = n.id)",
    "leaf_nodes": f"{_BASE} SELECT pos, id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM isa WHERE isa.pos = n.pos AND isa.parent = n.id)",
    "taxonomies": f"{_BASE} SELECT DISTINCT pos, id, path[-1] AS root FROM bare",
    "shortest_path_pairs": f"{_PAIRS} SELECT a, b, min(len)::BIGINT AS len FROM met GROUP BY a, b",
    "all_paths_pairs": f"{_PAIRS} SELECT a, b, s AS subsumer, len::BIGINT AS len, {_JOIN.format('list_concat(pa[1:list_position(pa, s)], list_reverse(pb[1:list_position(pb, s) - 1]))')} AS nodes FROM met",
    "lcs_by_path": f"{_PAIRS} SELECT DISTINCT a, b, s AS subsumer, len::BIGINT AS len FROM (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY len) AS k FROM met) WHERE k = 1",
    "lcs_by_depth": f"{_PAIRS}, deep AS (SELECT id, min(len(path)) AS d FROM rooted WHERE pos = 'n' GROUP BY id) SELECT a, b, s AS subsumer, d::BIGINT AS depth FROM (SELECT a, b, s, d, rank() OVER (PARTITION BY a, b ORDER BY d DESC) AS k FROM (SELECT DISTINCT a, b, s FROM met) JOIN deep ON deep.id = s) WHERE k = 1",
    "lcs_by_ic": f"{_PAIRS}, {_COUNTS} SELECT a, b, s AS subsumer, round(ic, 6) + 0.0 AS ic FROM (SELECT a, b, s, ic, rank() OVER (PARTITION BY a, b ORDER BY ic DESC) AS k FROM (SELECT DISTINCT a, b, s FROM met) JOIN info ON info.pos = 'n' AND info.id = s) WHERE k = 1",
    "freq_propagate": _freq_sql(SQL_OWN), "freq_add1": _freq_sql(_ADD1),
    "root_freq": f"WITH RECURSIVE {SQL_ISA}, {SQL_NODES}, {_COUNTS} SELECT pos, r AS root_freq FROM roots",
    "ic_table": f"WITH RECURSIVE {SQL_ISA}, {SQL_NODES}, {_COUNTS} SELECT pos, id, freq, round(freq / r, 9) + 0.0 AS prob, round(ic, 6) + 0.0 AS ic FROM info",
    **{f"sim_{m}": _sim_sql(m, True) for m in ("path", "lch", "wup", "res", "lin", "jcn")}, **{f"sim_{m}_noroot": _sim_sql(m, False) for m in ("path", "lch", "wup", "res", "lin", "jcn")},
    "sim_cross_pos": f"SELECT DISTINCT 'n' AS pos_a, c_custkey + {dl.CUSTOMER} AS a, 'v' AS pos_b, {dl.USER} + id * {dl.USERS} + user_id AS b, -1000000.0::DOUBLE AS score, 1::BIGINT AS err_level, 'n and v are different parts of speech.' AS err_msg FROM events JOIN {dl._rank('events', 'event_type', 0)} ON event_type = v JOIN customer ON c_custkey = user_id",
    "sim_random": f"WITH {SQL_PAIRS} SELECT a, b, round(('0x' || substr(md5(least('n#' || a, 'n#' || b) || '|' || greatest('n#' || a, 'n#' || b)), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)}, 3) AS score FROM pairs",
    **{f"rel_{r}": f"{_RELS} SELECT DISTINCT src AS key, dst_pos AS pos, dst AS id FROM rels WHERE rel = '{r}'" for r in ("hype", "hypo", "mero", "holo", "sim", "attr", "enta", "caus")},
    "rel_compose": f"{_RELS} SELECT DISTINCT m.src AS key, s.dst_pos AS pos, s.dst AS id FROM rels m JOIN rels s ON s.rel = 'sim' AND s.src = m.dst WHERE m.rel = 'mero'",
    "sim_hso": _HSO,
    "trace_lch": f"{_PAIRS}, {_TOPS} SELECT a, b, arg_min(s, (len, s)) AS subsumer, min(len)::BIGINT AS len, (SELECT max(depth) + 1 FROM tops WHERE pos = 'n')::BIGINT AS depth, round(ln(2.0 * (SELECT max(depth) + 1 FROM tops WHERE pos = 'n') / min(len)), 6) + 0.0 AS score FROM met GROUP BY a, b",
    "trace_wup": f"{_PAIRS}, {_deep_sql('rooted')} SELECT a, b, s AS subsumer, d::BIGINT AS depth, la::BIGINT AS la, lb::BIGINT AS lb, round(w, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY w DESC, s) AS k FROM (SELECT c.a, c.b, c.s, d, f.l AS la, g.l AS lb, 2.0 * d / (d + f.l - 1 + d + g.l - 1) AS w FROM cand c JOIN far f ON f.x = c.a AND f.s = c.s JOIN far g ON g.x = c.b AND g.s = c.s)) WHERE k = 1",
    "trace_lin": f"{_PAIRS}, {_COUNTS}, {_TRACED} SELECT a, b, sub AS subsumer, round(l, 6) + 0.0 AS ic_l, round(ia, 6) + 0.0 AS ic_a, round(ib, 6) + 0.0 AS ic_b, coalesce(fl, 0)::BIGINT AS freq_l, coalesce(fa, 0)::BIGINT AS freq_a, coalesce(fb, 0)::BIGINT AS freq_b, r::BIGINT AS root_freq, round({_FORMULA['lin']}, 6) + 0.0 AS score FROM inf",
    "trace_hso": _HSO.replace("AS score\nFROM named n LEFT", f"AS score, {_KIND} AS kind, 0::BIGINT AS n_bad\nFROM named n LEFT"),
    **{f"rel_{r}": f"WITH {dl.SQL_WORDS} SELECT DISTINCT src || ':' || src_word AS key, dst_pos AS pos, dst AS id, dst_word AS word FROM words WHERE rel = '{r}'" for r in ("also", "ants", "pert", "deri")},
    "score_cache": _sim_sql("path", True),
    "rel_compose_words": f"WITH {dl.SQL_WORDS} SELECT DISTINCT x.src AS key, y.dst_pos AS pos, y.dst AS id, y.dst_word AS word FROM words x JOIN pw ON pw.id = x.src AND pw.w1 = x.src_word JOIN words y ON y.rel = 'also' AND y.src = x.dst AND y.src_word = x.dst_word WHERE x.rel = 'ants'",
    "hso_links_words": f"{_RELS}, {dl.SQL_WORDS} SELECT DISTINCT CASE WHEN rel IN ('sim', 'attr') THEN 'H' WHEN rel IN ('hype', 'mero') THEN 'U' ELSE 'D' END AS dir, src_pos, src, dst_pos, dst FROM rels UNION SELECT 'H', 'n', w.src, 'n', w.dst FROM words w JOIN pw ON pw.id = w.src AND pw.w1 = w.src_word WHERE w.rel IN ('ants', 'also', 'pert')",
    "hso_links": f"{_RELS} SELECT DISTINCT CASE WHEN rel IN ('sim', 'attr') THEN 'H' WHEN rel IN ('hype', 'mero') THEN 'U' ELSE 'D' END AS dir, src_pos, src, dst_pos, dst FROM rels",
}
