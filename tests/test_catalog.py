"""Named queries against their DuckDB equivalents on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from relspark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
NAMES = [
    "isa_closure", "first_depth_lexical", "taxonomy_depth", "all_paths_pairs", "lcs_by_ic", "freq_add1", "ic_table", "sim_path", "sim_lch_noroot", "sim_wup", "sim_jcn", "sim_cross_pos", "sim_random",
    "rel_compose", "hso_links", "gloss_clean", "gloss_examples", "tfidf", "vector_prune", "sim_vector", "sim_vector_pairs", "stop_filter_compound", "freq_resnik", "super_gloss", "sense_lookup", "best_sense",
    "ranking_lines", "wps_validate", "pair_file_parse", "corpus_clauses", "rel_ants", "rel_compose_words", "hso_links_words",
    "trace_lch", "trace_wup", "trace_lin", "trace_hso", "trace_lesk", "trace_vector",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    expected = duck.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in expected.description].index(c) for c in columns]
    theirs = [tuple(r[i] for i in at) for r in expected.fetchall()]
    assert plain(tuple(r) for r in frame.select(columns).collect()) == plain(theirs)


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) <= set(queries)
    assert len(catalog.ORACLE_SQL) >= 60


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
