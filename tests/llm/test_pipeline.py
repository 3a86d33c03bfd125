"""The pipeline's stages against plain versions of their rules, each on its own input."""

import zlib

import corpus_pipeline
import numpy as np
from relspark.llm import packing, quality, queries, token_counts
from relspark.llm.common import text_buffer
from test_pairs import brute_classes
from test_text_operators import contamination

import pyarrow as pa

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    inputs, steps = [docs.collect()], {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        inputs.append(docs.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    whole, good, cut, one, clean, packed = inputs

    field = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: field.scores(quality.lines(*text_buffer(pa.array([r["text"]]))))[0] for r in whole}
    assert {r["doc_id"] for r in good} == {d for d, s in scores.items() if s >= quality.THRESHOLD}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [r["doc_id"] in {g["doc_id"] for g in good} for r in whole if labels.get(r["doc_id"]) == 1]
    assert np.mean(kept) > 0.98

    pages = {}
    for r in good:
        pages.setdefault(r["source"], []).append({x.strip(" ") for x in r["text"].split("\n")} - {""})
    counts = {}
    for host, own in pages.items():
        for page in own:
            for line in page:
                counts[host, line] = counts.get((host, line), 0) + 1
    bad = {k for k, n in counts.items() if n > 1 and len(pages[k[0]]) >= 10 and n > 0.1 * len(pages[k[0]])}
    expected = {}
    for r in good:
        lines = r["text"].split("\n")
        left = [x for x in lines if not x.strip(" ") or (r["source"], x.strip(" ")) not in bad]
        if len(left) == len(lines) or "\n".join(left).strip(" "):
            expected[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in cut} == expected and any(expected[r["doc_id"]] != r["text"] for r in good if r["doc_id"] in expected)
    assert all(r["n_chars"] == len(r["text"]) for r in cut)

    assert {r["doc_id"] for r in one} == {c for _, c, _ in brute_classes([(r["doc_id"], r["text"]) for r in cut])} and len(one) < len(cut)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = {w for _, t in items for w in t.lower().split()}
    suspects = [r for r in one if len(words & set(r["text"].lower().split())) >= 8][:60]
    verdicts = {r["doc_id"]: contamination(r["text"], items)[-1] for r in suspects}
    left = {r["doc_id"] for r in clean}
    assert {d for d in verdicts if d in left} == {d for d, v in verdicts.items() if not v} and len(clean) < len(one)

    tokenizer = token_counts.tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    rows = []
    for r in clean:
        own = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        rows += [(r["doc_id"], k, s, n, zlib.crc32(np.array(own[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(own), 1024))]
    assert sorted(tuple(r[:5]) for r in packed) == sorted(rows)
    assert len({r["sequence_id"] for r in packed}) <= -(-sum(r["length"] for r in packed) // 1024) * 1.01 + 1


def test_run(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
