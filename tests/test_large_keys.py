"""Concepts of the derived lexicon with keys as large as those of tables of sf100 and more."""

import pytest

from relspark.plans import driver_lexicon as dl, taxonomy_queries as tq, text_queries as xq

FAR_CUSTOMERS, PARTS, USERS = [1_000_001, 1_000_002, 2_000_001], [1, 2, 7_000_001, 7_000_002], [1, 1_000_001]
TABLES = {
    "region": ("r_regionkey long, r_name string", [(0, "ASIA")]),
    "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "INDIA", 0), (1, "CHINA", 0)]),
    "customer": ("c_custkey long, c_name string, c_nationkey long, c_mktsegment string", [(k, f"Customer {k}", 0, "AUTO") for k in [1, *FAR_CUSTOMERS]]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(1, "Supplier 1", 1), (1_000_001, "Supplier 1000001", 1)]),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int", [(k, f"part {k}", "Brand#1", "TIN", k % 10) for k in PARTS]),
    "orders": ("o_orderkey long, o_custkey long, o_orderpriority string", [(1, 1_000_001, "LOW"), (2, 2_000_001, "LOW")]),
    "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", [(1, 1, 7_000_001, 1), (1, 2, 1, 1), (2, 1, 7_000_002, 1_000_001)]),
    "events": ("event_type string, user_id long", [(e, u) for e in ("click", "view") for u in USERS]),
}


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("far"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_concepts_never_meet(spark, far):
    nodes = dl.nodes(spark, far).collect()
    ids = {(r["pos"], r["id"]) for r in nodes}
    at = {r["name"]: r["id"] for r in nodes}
    assert len(ids) == len(nodes) == 25
    assert (at["Customer 1"], at["Supplier 1"], at["part 2"], at["order 2"], at["view 1"]) == (dl.CUSTOMER + 1, dl.SUPPLIER + 1, dl.PART + 2, dl.ORDER + 2, dl.USER + 2 * dl.USERS + 1)
    parents = {}
    for r in dl.isa(spark, far).collect():
        parents.setdefault((r["pos"], r["child"]), set()).add(r["parent"])
    assert set(parents) <= ids and {("n", p) for (pos, _), found in parents.items() if pos == "n" for p in found} <= ids
    assert parents["n", at["Supplier 1"]] == {at["CHINA"]} and parents["n", at["Customer 1000001"]] == {at["INDIA"], at["AUTO"]}
    assert parents["n", at["order 1"]] == {at["Customer 1000001"], at["LOW"]} and parents["v", at["click 1000001"]] == {at["click"]}


def test_pairs_and_counts(spark, far):
    at = {r["name"]: r["id"] for r in dl.nodes(spark, far).collect()}
    parts = {(r["a"], r["b"]) for r in xq.part_pairs(spark, far).collect()}
    assert parts == {(at[f"part {a}"], at[f"part {b}"]) for a, b in [(1, 2), (7_000_001, 7_000_002), (7_000_001, 1)]}
    every = {(r["a"], r["b"]) for r in dl.pairs(spark, far).collect()}
    assert (at["Customer 1000001"], at["Customer 1000002"]) in every and (at["Customer 1000001"], at["Supplier 1"]) in every
    freq = {(r["pos"], r["id"]): r["freq"] for r in tq.freq_propagate(spark, far).collect()}
    assert freq["n", at["part 7000001"]] == 1 and freq["n", at["Supplier 1"]] == 2 and freq["v", at["view"]] == 2
    senses = {r["id"]: r["word"] for r in dl.lexicon(spark, far).sense.where("pos = 'n'").collect()}
    assert senses[at["Customer 2000001"]] == "customer_2000001" and senses[at["part 7000001"]] == "brand1_tin_1"
