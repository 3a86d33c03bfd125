"""Tokenizer alignment, centroid clustering and URL filters against plain versions."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relspark.llm import alignment, clustering, queries, url_filter

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
FAST = (A, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
TEXTS = [
    None, "", " ", "  ", "a", "The quick  brown fox", " lead", "trail ", "tab\tnew\nline \n x", "<|endoftext|> and <s> and <0x41>", "naïve café — “quoted” 😀😀",
    "日本語の文章 です", "a ▁b", "x" * 300, "it's they'll 1234567 3.14!!", "é è ü ß Ə", "a\u00a0b \u2003c", "\x00 \x01", "no​zero width", "The quick  brown fox",
]


def plain_tokens(text):
    """Both sides' (id, bytes) of the whole text at once."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    codes = alignment.byte_of_character()
    a = [(i, bytes(codes[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in s.encode(text):
        name = s.id_to_piece(i)
        b.append((i, bytes([int(name[3:5], 16)]) if s.is_byte(i) else name.replace("▁", " ").encode()))
    return a, b


def plain_groups(text):
    if not text:
        return []
    a, b = plain_tokens(text)
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
        return []
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        out.append(([t for t, _ in a[i:k]], [t for t, _ in b[j:m]]))
        i, j = k, m
    return out


def plain_summary(texts):
    groups = [plain_groups(t) for t in texts]
    count = Counter((g[0][-1], g[1][-1]) for own in groups for g in own)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for own in groups:
        links = [(g[0][-1], g[1][-1]) for g in own]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        rows.append((
            sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if own else "",
        ))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("head", [alignment.HEAD_PAIRS, 5, 0])
def test_alignment_of_odd_texts(spark, head):
    docs = spark.createDataFrame([(i if i % 7 else None, t, 0, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, pair int, _id string")
    got = alignment.summarize(docs, A if head else FAST, B, head_pairs=head)
    expected = Counter((i if i % 7 else None, *row) for i, row in enumerate(plain_summary(TEXTS)))
    assert Counter(tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in got.collect()) == expected
    assert alignment.summarize(docs.limit(0), A, B, head_pairs=head).count() == 0


def test_alignment_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = Counter((r["doc_id"], *s) for r, s in zip(rows, plain_summary([r["text"] for r in rows])))
    assert Counter(tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in queries.op11_tokenizer_alignment(spark, SF).collect()) == expected


def test_overlaps_are_the_pairs_that_share_bytes(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("doc_id", F.lit(1))
    for r, text in zip(alignment.align(docs.coalesce(1), A, B, overlaps=True).collect(), TEXTS):
        if not r["a_ids"]:
            assert r["n_overlaps"] == 0 and not r["overlap_a"]
            continue
        a, b = plain_tokens(text)
        spans = [np.cumsum([0] + [len(x) for _, x in side]).tolist() for side in (a, b)]
        expected = [(i, j) for i in range(len(a)) for j in range(len(b)) if spans[0][i] < spans[1][j + 1] and spans[1][j] < spans[0][i + 1]]
        assert list(zip(r["overlap_a"], r["overlap_b"])) == expected and r["n_overlaps"] == len(expected)
        assert [sum(r["group_a"]), sum(r["group_b"])] == [len(a), len(b)]


def test_owners_in_steps():
    rng = np.random.default_rng(3)
    a, b = (np.unique(np.append(rng.integers(1, 5000, n), 5000)) for n in (900, 1300))
    whole = alignment.owners(a, b)
    for step in (1, 7, 640):
        assert all((x == y).all() for x, y in zip(whole, alignment.owners(a, b, step)))


def test_alignment_of_a_long_text(monkeypatch):
    """Over several passes' bytes, with more parts than a worker remembers, equal to the whole text at once."""
    monkeypatch.setattr(alignment, "KNOWN_PARTS", 500)
    rng = np.random.default_rng(5)
    text = " ".join(f"w{rng.integers(4000)}x" + ("  \n" if k % 50 == 0 else "") for k in range(400_000))
    assert len(text) > 2 << 20
    made = alignment.align_texts(pa.array(["first", text, "last"]), alignment.Encoded(alignment.loaded(A), alignment.loaded(B)))
    a, b = plain_tokens(text)
    assert made["a_ids"][1].as_py() == [i for i, _ in a] and made["b_ids"][1].as_py() == [i for i, _ in b]
    ends = [np.cumsum([len(x) for _, x in side]) for side in (a, b)]
    assert len(made["group_a"][1]) == len(np.intersect1d(*ends))


# --- clustering ---------------------------------------------------------------


def plain_lloyd(rows, clusters, rounds, size):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) * 256 < 2**63 for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in start[:clusters]]
    if not centroids:
        return []
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for c, vs in zip(centroids, own)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, k, d in found:
        inertia[k] += d
    fit = lambda n: n if n < 2**63 else None
    return [(i, k, fit(d), fit(inertia[k]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in found]


CLUSTER_COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustered(df, **options):
    return Counter(tuple(r[c] for c in CLUSTER_COLUMNS) for r in clustering.cluster(df, **options).collect())


def test_clusters_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 3]) for i in range(300)]
    rows += [(5, rows[5][1]), (5, [0.0] * 4), (None, [1.0] * 4), (900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("inf")] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id int")
    assert clustered(df, clusters=7, size=4) == Counter(plain_lloyd(rows, 7, 5, 4))
    copies = [(i, [0.5, -0.5, 0.25, 1.0]) for i in range(50)]  # all centroids alike: ties, and clusters left empty
    assert clustered(spark.createDataFrame(copies, "vec_id long, embedding array<double>"), clusters=7, size=4) == Counter(plain_lloyd(copies, 7, 5, 4))
    assert clustered(df.limit(0), size=4) == Counter() and clustered(df.where("vec_id is null"), size=4) == Counter()
    assert clustered(df.where("vec_id < 3"), clusters=7, size=4) == Counter(plain_lloyd(rows[:3], 7, 5, 4))


def test_clusters_of_large_components(spark):
    rows = [(i, [1e6 * i, -3e15 + i, 0.1, 2.0**54]) for i in range(20)] + [(99, [1e300] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clustered(df, clusters=3, size=4, rounds=2) == Counter(plain_lloyd(rows, 3, 2, 4))


# --- URLs ---------------------------------------------------------------------


def test_hosts_and_paths(spark):
    cases = {
        None: ("", ""), "": ("", ""), "no host/path": ("", ""), "http://A.Example.ORG": ("a.example.org", ""), "http://h/?q": ("h", "/"), "x://u@H:80/a?b#c": ("u@h:80", "/a"),
        "http://h?x/y": ("h", ""), "http://h#x/y": ("h", ""), "a\nb://h/p\nq?x": ("h", "/p\nq"), "http://ÄB.de/ÄB": ("Äb.de", "/ÄB"), "://": ("", ""), "a://b://c": ("b:", "//c"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = url_filter.host_and_path(F.col("url"))
    assert {r["url"]: (r["h"], r["p"]) for r in df.select("url", host.alias("h"), path.alias("p")).collect()} == cases


def test_rules(spark):
    cases = {
        "http://example.org/en/2": ("org/", "allow"), "http://a.example.org/es/x": ("example.org/es/", "block"), "http://badexample.org/es/x": ("org/", "allow"),
        "http://example.org/en/17": ("example.org/en/1", "block"), "http://x.com/fr/1": ("com/fr/", "allow"), "http://x.com/de/1": ("com/de/", "block"), "http://com/fr/": ("com/fr/", "allow"),
        "http://x.com/en/1": (None, "allow"), "http://example.org": (None, "allow"), "http://org.net/": (None, "allow"), None: (None, "allow"), "org/": (None, "allow"),
    }
    pages = spark.createDataFrame([(1, u, "z", 3) for u in cases], "page_id int, url string, host string, rule int")
    none = pages.limit(0).select("url", F.lit(True).alias("bad"))
    got = url_filter.judge(pages.withColumn("was", F.col("url")), none, queries.URL_RULES)
    assert sorted((r["rule"] or "", r["verdict"]) for r in got.collect()) == sorted((a or "", b) for a, b in cases.values())
    host, path = url_filter.host_and_path(F.col("url"))
    found = pages.select("url", url_filter.matched(host, path, queries.URL_RULES).alias("m")).collect()
    assert {r["url"]: r["m"] and r["m"]["rule"] for r in found} == {u: a for u, (a, _) in cases.items()}
    assert url_filter.judge(pages.limit(0), none, queries.URL_RULES).count() == 0


def plain_reputation(hosts, outcomes):
    """outcomes: (site, bad) of labelled pages."""
    n, bad = Counter(s for s, _ in outcomes), Counter(s for s, b in outcomes if b)
    suffix = {s: next((t for t in url_filter.TWO_LABELS if s == t or s.endswith("." + t)), s.split(".")[-1]) for s in hosts}
    domain = {}
    for s in hosts:
        left = s[: -len(suffix[s])].rstrip(".").split(".")[-1]
        domain[s] = f"{left}.{suffix[s]}" if left or s.startswith(".") else suffix[s]

    def shrink(members):  # name: (n, bad, mean above)
        over = sum((b - k * m) ** 2 - k * m * (1 - m) for k, b, m in members.values())
        base = sum(k * (k - 1) * m * (1 - m) for k, b, m in members.values())
        s = 1 / min(max(over / base if base else url_filter.LEAST, url_filter.LEAST), url_filter.GREATEST) - 1
        return {name: (b + s * m) / (k + s) for name, (k, b, m) in members.items()}, s

    total = lambda keys, of: {k: (sum(n[s] for s in hosts if of[s] == k), sum(bad[s] for s in hosts if of[s] == k)) for k in keys}
    mean = (sum(bad.values()) + 0.5) / (sum(n.values()) + 1)
    top, _ = shrink({k: (*v, mean) for k, v in total(set(suffix.values()), suffix).items()})
    above = {domain[s]: suffix[s] for s in hosts}
    middle, _ = shrink({k: (*v, top[above[k]]) for k, v in total(set(domain.values()), domain).items()})
    low, s = shrink({h: (n[h], bad[h], middle[domain[h]]) for h in hosts})
    return {h: (p, p - url_filter.Z * math.sqrt(p * (1 - p) / (n[h] + s + 1))) for h, p in low.items()}


def test_reputation_against_plain_sums(spark):
    """Spam hosts are blocked, one of a single bad page is not; unlabelled hosts lean on their domain."""
    outcomes = [("spam.bad.net", True)] * 60 + [("other.bad.net", True)] * 40 + [("good.net", False)] * 200 + [("one.good.net", True)] + [("a.shop.co.uk", False)] * 30 + [("b.shop.co.uk", True)] * 3 + [("", False)]
    hosts = {h for h, _ in outcomes} | {"new.bad.net", "new.good.net", "localhost", "co.uk", "x.org"}
    pages = spark.createDataFrame([(i, f"http://{h}:80/en/{i}") for i, h in enumerate(sorted(hosts) * 3)], "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://me@{h}/x", b) for h, b in outcomes] + [("http://good.net/", None)], "url string, bad boolean")
    got = {r["host"].removesuffix(":80"): r for r in url_filter.judge(pages, labelled, []).collect()}
    for h, (rate, bound) in plain_reputation(hosts, outcomes).items():
        assert abs(got[h]["bad_rate"] - rate) < 2e-6 and abs(got[h]["bad_bound"] - bound) < 2e-6, h
        assert got[h]["verdict"] == ("block" if bound > url_filter.LIMIT else "allow")
    assert {h for h, r in got.items() if r["verdict"] == "block"} >= {"spam.bad.net", "other.bad.net"}
    assert got["one.good.net"]["verdict"] == got["new.good.net"]["verdict"] == "allow"
    assert got["new.bad.net"]["bad_rate"] > got["new.good.net"]["bad_rate"]


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_url_filter"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    columns = ", ".join(sorted(frame.columns))
    expected = con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in frame.select(sorted(frame.columns)).collect()) == Counter(expected)
