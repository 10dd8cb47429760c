"""The network against a plain convolution, its accuracy on held-out rows, and odd rows."""

import zlib

import numpy as np

from millrace.llm import language_id as L


def plain(network, row):
    """One window's probabilities, filter by filter."""
    x, pooled = network.weights["embedding"][row], []
    for w in L.WIDTHS:
        f = network.weights[f"filters{w}"]
        at = [sum(x[p + j] @ f[j] for j in range(w)) for p in range(len(row) - w + 1)]
        pooled.append(np.maximum(np.max(at, axis=0) + network.weights[f"bias{w}"], 0))
    logits = np.concatenate(pooled) @ network.weights["out"] + network.weights["out_bias"]
    e = np.exp(logits - logits.max())
    return e / e.sum()


def test_tables_equal_plain_convolution():
    network = L.Network(["a", "b", "c"])
    cut, _ = L.windows("Ein Satz über Flüsse. " * 20)
    assert np.allclose(network.probabilities(cut), [plain(network, row) for row in cut], atol=1e-5)


def test_gradients_equal_differences():
    network, rng = L.Network(["a", "b"]), np.random.default_rng(0)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    cut, labels = rng.integers(0, 256, (3, L.WINDOW)).astype(np.uint8), np.array([0, 1, 1])

    def loss():
        return -np.mean([np.log(plain(network, row)[y]) for row, y in zip(cut, labels)])

    network.tables = {w: np.einsum("be,jef->jbf", network.weights["embedding"], network.weights[f"filters{w}"]) for w in L.WIDTHS}
    grads = network.gradients(cut, labels)
    for name, at in (("out", (3, 1)), ("bias3", (2,)), ("filters2", (1, 4, 5)), ("embedding", (int(cut[0, 7]), 3))):
        w = network.weights[name]
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5, name


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r["doc_id"]: r for r in docs.collect()}
    rows = L.identified(docs, L.fit(docs)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(known)
    hits = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        text, lang = known[r["doc_id"]]["text"], known[r["doc_id"]]["lang"]
        assert (r["lang_pred"] == L.UNKNOWN) == (not any(map(str.isalpha, text or "")))
        if r["held_out"] and lang and r["lang_pred"] != L.UNKNOWN:
            hits.append(r["lang_pred"] == lang)
    assert len(hits) > 150 and np.mean(hits) > 0.93


def test_batching_does_not_matter(spark, docs, texts):
    network = L.fit(docs, epochs=1)
    whole, one = L.predict_texts(network, list(texts.values()), 64), [L.predict_texts(network, [t]) for t in texts.values()]
    assert whole[0] == [x[0][0] for x in one] and np.allclose(whole[1], [x[1][0] for x in one], atol=1e-5)


def test_odd_rows(spark, odd, docs):
    network = L.fit(docs)
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.identified(odd, network).collect()]
    assert len(found) == odd.count() and all(x[1:] == ("und", 0.0) for x in found if x[0] in (1, 2, 4, 7))
    kept = L.keep_identified(odd, network)
    assert kept.columns == odd.columns and {3, 5, 6} <= {r["doc_id"] for r in kept.collect()} and not {1, 2, 4, 7} & {r["doc_id"] for r in kept.collect()}
    assert L.fit(odd.limit(0)) is None and L.identified(odd.limit(0), None).count() == 0 and L.identified(odd, None).where("lang_pred <> 'und'").count() == 0


def test_query_by_plain_convolution(spark, sf, docs, texts):
    """The registered query's languages and scores, window by window and filter by filter."""
    from millrace.llm import registry

    network = L.fit(docs)
    rows = {r["doc_id"]: r for r in registry.queries()["op1_language_id"](spark, sf).collect()}
    assert sorted(rows) == sorted(texts)
    checked = 0
    for i, t in texts.items():
        if t and any(map(str.isalpha, t)) and len(t) < 1200:
            cut, sizes = L.windows(t)
            p = np.average([plain(network, row) for row in cut], axis=0, weights=sizes)
            assert rows[i]["lang_pred"] == network.languages[int(p.argmax())] and abs(rows[i]["score"] - p.max()) < 1e-4
            checked += 1
    assert checked > 30


def test_every_language_is_learned(spark):
    """Many languages, some with one row."""
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 40, f"l{k}") for k in range(600)] + [(1000 + k, "ab cd " * 50, "l1") for k in range(40)]
    network = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), epochs=1)
    import zlib

    assert len(network.languages) == len({x for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 != 2}) > 400
