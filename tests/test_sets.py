"""Products of texts are made once for each two sets of words."""

from relspark.operators import vectors as vec


def test_equal_texts_are_one(spark, monkeypatch):
    texts = {f"k{n}": ("red", "big") if n % 2 else ("big", "old", "odd") for n in range(40)} | {"stopped": ("the",), "unknown": ("odd",)}
    words = spark.createDataFrame([(k, w) for k, ws in texts.items() for w in ws], "key string, word string")
    vectors = spark.createDataFrame([("red", "x", 1), ("big", "x", 2), ("big", "y", 3), ("old", "y", 1), ("the", "y", 9)], "word string, dim string, cnt long")
    stop = spark.createDataFrame([("the",)], "word string")
    keys = [*texts, "none"]
    pairs = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(zip(keys, keys[3:] + keys[:3]))], "n int, a string, b string")
    asked, products = [], vec.products
    monkeypatch.setattr(vec, "products", lambda rows, context: asked.append(rows.count()) or products(rows, context))
    rows = {r["n"]: r for r in vec.set_products(pairs, words, vectors, stop).collect()}
    context = vec.context_vectors(words, vectors, stop)
    old = {r["n"]: (r["dot"], r["na"], r["nb"]) for r in products(pairs, context).collect()}
    assert {n: (r["dot"], r["na"], r["nb"]) for n, r in rows.items()} == old and len(rows) == len(keys)
    assert asked[0] <= 9  # of 43 pairs
    assert rows[1]["words_a"] == ["big", "red"] and rows[0]["words_a"] == ["big", "old"] and rows[keys.index("stopped")]["words_a"] is None
