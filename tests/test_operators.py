import itertools
import random

from pyspark.sql import functions as F

from millrace.operators import assignment, dedup, records, retrieval, selection, statistics, validation


def test_ranks_give_worked_values(spark):
    ranked = spark.createDataFrame([("a", 1), ("a", 3), ("b", None), ("c", 3)], "q string, rank int")
    got = {r["q"]: r for r in retrieval.metrics_from_ranks(ranked, "q", "rank").collect()}
    assert got["a"]["recall_at_1"] == 0.5 and abs(got["a"]["average_precision"] - (1 + 2 / 3) / 2) < 1e-12
    assert got["b"]["mrr_at_10"] == 0 and got["b"]["ndcg_at_10"] == 0
    assert abs(got["c"]["mrr_at_10"] - 1 / 3) < 1e-12 and abs(got["c"]["ndcg_at_10"] - 0.5) < 1e-12


def test_pool_rank_is_pessimistic(spark):
    m = retrieval.pool_metrics(F.lit(0.5), F.array(F.lit(0.5), F.lit(0.1)))
    row = spark.range(1).select(*(c.alias(n) for n, c in m.items())).first()
    assert row["pool_rank"] == 2 and row["pool_recall_at_5"] is None and row["near_zero"]


def test_youden_worked_values(spark):
    rows = [("a", 0.9, True), ("a", 0.8, False), ("a", 0.1, False), ("b", 0.7, True), ("b", 0.6, False), ("b", 0.2, False)]
    r = retrieval.youden_threshold(spark.createDataFrame(rows, "query string, score double, positive boolean")).first()
    assert r["threshold"] == 0.7 and r["tpr"] == 1.0 and r["fpr"] == 0.25 and r["j"] == 0.75


def test_dense_search_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    got = {(r["query"], r["rank"]): r["doc"] for r in retrieval.dense_scores(df, df.where("id < 7"), 5, "id", "v").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q, v in rows[:7]:
        best = sorted((r for r in rows if r[1]), key=lambda r: (-dot(v, r[1]), r[0]))[:5]
        assert [got[q, k + 1] for k in range(5)] == [b[0] for b in best]


def test_components_and_near_pairs_match_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3))) & ((1 << 64) - 1) for b in base for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long").repartition(3)
    pairs = {(r["a"], r["b"]) for r in dedup.near_pairs(df).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert pairs == want and want
    got = {r["node"]: r["root"] for r in dedup.components(spark.createDataFrame(sorted(want), "a long, b long")).collect()}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in {x for p in want for x in p}}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in dedup.components(edges).collect()} == {0}


def test_greedy_split_covers_all_and_balances(spark):
    sizes = spark.createDataFrame([(i, 1 + i % 3) for i in range(300)], "root long, n long")
    got = assignment.greedy_split(sizes, {"train": 0.8, "dev": 0.1, "test": 0.1}).join(sizes, "root")
    per = {r["split"]: r["n"] for r in got.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert got.count() == 300 and abs(per["train"] / 600 - 0.8) < 0.02 and abs(per["dev"] / 600 - 0.1) < 0.02


def test_validation_routes(spark):
    doc = "struct<doc_id:string,text:string>"
    long = "to jest dość długi tekst dokumentu"
    rows = [
        ("1", "pytanie o coś", [("p", long)], [(f"n{i}", f"{long} {i}") for i in range(10)], "pl"),
        ("2", " ", [("p", long)], [], "pl"),
        ("3", "pytanie", None, [], "pl"),
        ("4", "pytanie", [("p", long)], [("p", long + "!")] * 10, "pl"),
        (None, "pytanie", [("p", "<p>" + long)], [(f"n{i}", f"{long} {i}") for i in range(10)], None),
    ]
    df = spark.createDataFrame(rows, f"example_id string, query string, positives array<{doc}>, hard_negatives array<{doc}>, language string")
    got = {r["query"] + str(r["example_id"]): (set(r["issues"]), r["route"]) for r in validation.routed(df).collect()}
    assert got["pytanie o coś1"] == (set(), "accepted")
    assert got[" 2"][0] >= {"empty_query", "too_few_negatives"} and got[" 2"][1] == "rejected"
    assert got["pytanie3"][0] == {"invalid_documents"}
    assert {"duplicate_doc_id", "positive_negative_overlap"} <= got["pytanie4"][0]
    assert got["pytanieNone"][0] == {"missing_id", "html"}


def test_kappa_of_perfect_and_certain_raters(spark):
    r = statistics.cohen_kappa(spark.createDataFrame([("x", "x"), ("y", "y")], "a string, b string"), "a", "b").first()
    assert r["kappa"] == 1.0
    assert statistics.cohen_kappa(spark.createDataFrame([("x", "x")], "a string, b string"), "a", "b").first()["kappa"] is None
    f = statistics.fleiss_kappa(spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "y")], "i int, l string"), "i", "l", 2).first()
    assert f["kappa"] == 1.0


def test_paired_bootstrap_is_deterministic(spark):
    df = spark.createDataFrame([("m", i, 0.0, v) for i, v in enumerate((1.0, 0.0, 1.0))], "metric string, id int, l double, r double")
    a, b = (statistics.paired_bootstrap(df.repartition(n), "metric", "l", "r", "id", 200).first() for n in (1, 3))
    assert a == b and abs(a["difference"] - 2 / 3) < 1e-12
    p = statistics.poisson_bootstrap(df, "metric", "l", "r", "id", 300).first()
    assert p["low"] <= 2 / 3 <= p["high"]


def test_largest_remainder_sums_up(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "s string, n long")
    assert sum(r["quota"] for r in selection.largest_remainder(counts, "s", "n", 7).collect()) == 7


def test_preference_pairs_respect_margin(spark):
    rows = [("t", "p", i, q, s, True, True) for i, (q, s) in enumerate([("a b", 3.0), ("a b", 1.0), ("c d", 2.5), ("e f", 1.0)])]
    df = spark.createDataFrame(rows, "split string, passage string, candidate long, query string, score double, chosen_ok boolean, rejected_ok boolean")
    got = [(r["chosen"], r["rejected"]) for r in selection.preference_pairs(df, 1.0, 0.5, 3).collect()]
    assert got == [(0, 3)]


def test_ids_digest_ignores_order(spark):
    a = records.ids_digest(spark.range(50).repartition(7), "id").first()
    b = records.ids_digest(spark.range(50).orderBy(F.desc("id")), "id").first()
    assert a == b and a["n"] == 50 and a != records.ids_digest(spark.range(49), "id").first()


def test_aligned_lists(spark):
    df = spark.createDataFrame([(["1", "2"], ["x", "y"], [23.5, 1.0])], "ids array<string>, texts array<string>, scores array<double>")
    docs = records.aligned("ids", "texts", "scores")
    assert len(df.select(records.score_filter(docs, 23.5).alias("d")).first()["d"]) == 1
    assert df.select(records.score_filter(docs, 23.5, strict=True).alias("d")).first()["d"] == []


# against plain Python


def test_common_runs_match_the_textbook(spark):
    from millrace.functions import lexical

    rng = random.Random(2)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 14))]) for i in range(80)] + [(80, None, ["a"])]

    def want(q, p):
        run = [[0] * (len(p) + 1) for _ in range(len(q) + 1)]
        lcs = [[0] * (len(p) + 1) for _ in range(len(q) + 1)]
        for i, x in enumerate(q):
            for j, y in enumerate(p):
                run[i + 1][j + 1] = run[i][j] + 1 if x == y else 0
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
        return max(map(max, run)), lcs[-1][-1]

    df = spark.createDataFrame(rows, "i int, q array<string>, p array<string>")
    for r in df.select("q", "p", lexical.common_runs("q", "p").alias("c")).collect():
        assert (r["c"]["longest"], r["c"]["lcs"]) == want(r["q"] or [], r["p"] or [])


def test_careful_sentences(spark):
    from millrace.functions import text as T

    cases = {
        "Urodził się w r. 1920. Zmarł np. we Lwowie. Koniec!": ["Urodził się w r. 1920.", "Zmarł np. we Lwowie.", "Koniec!"], "A. Nowak przyszedł. potem wyszedł. Tak?": ["A. Nowak przyszedł. potem wyszedł.", "Tak?"],
        "1. Wstęp. 26. Dalej": ["1. Wstęp.", "26. Dalej"], "...": ["..."], "": [], "  Jedno zdanie  ": ["Jedno zdanie"], "Było (tzw. cud). 12.": ["Było (tzw. cud). 12."], "W 1999. Rok był dobry.": ["W 1999.", "Rok był dobry."], "Dr. X. p.n.e. Y": ["Dr. X. p.n.e. Y"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["s"] for r in df.select("t", T.careful_sentences(F.col("t")).alias("s")).collect()}
    assert got == cases


def test_query_keys_and_folding(spark):
    from millrace.functions import text as T

    df = spark.createDataFrame([("Łódź  ŻÓŁTA",), ("Straße ΑΣ",), (None,), ("&eacute;&#x3c;b> &amp;lt;",)], "t string")
    rows = df.select(T.query_key("t").alias("k"), T.folded("t").alias("f"), T.unescaped("t").alias("u")).collect()
    assert [r["k"] for r in rows[:3]] == ["lodz zolta", "strasse ασ", None] and rows[1]["f"] == "strasse ασ" and rows[3]["u"] == "é<b> &lt;"


def test_cover_matches_a_plain_greedy(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.randint(0, 3) / 4, rng.sample("abcdef", rng.randint(0, 4)), rng.choice(["x", "y", None])) for g in range(6) for i in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "g int, i int, quality double, terms array<string>, form string")
    w = {"diversity": 0.5, "terms": 0.125, "form": 0.25, "duplicate": 1.0}
    got = {(r["g"], r["position"]): r["i"] for r in selection.greedy_cover(df, "g", "i", 3, **w).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for g in range(6):
        left, chosen = [(i, q, set(t), f) for x, i, q, t, f in rows if x == g], []
        while left and len(chosen) < 3:
            def gain(c, chosen=chosen):
                near = max((like(c[2], o[2]) for o in chosen), default=0.0)
                new = len(c[2] - set().union(*(o[2] for o in chosen))) * w["terms"]
                form = w["form"] * (c[3] is not None and all(c[3] != o[3] for o in chosen))
                return c[1] - w["diversity"] * near + new + form - w["duplicate"] * any(c[2] == o[2] for o in chosen)
            best = max(left, key=lambda c: (gain(c), c[1], c[0]))
            left.remove(best)
            chosen.append(best)
            assert got[g, len(chosen)] == best[0], (g, len(chosen))


def test_unique_cohort_is_one_pass(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(30), rng.choice([None, *range(25)])) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, a int, b int")
    got = [r["i"] for r in selection.unique_cohort(df, "a", "b", "i", 1000, "s").collect()]
    import hashlib

    seen, want = (set(), set()), []
    for i, a, b in sorted(rows, key=lambda r: (hashlib.sha256(f"s:{r[0]}".encode()).hexdigest(), str(r[0]))):
        if a not in seen[0] and (b is None or b not in seen[1]):
            want.append(i)
            seen[0].add(a)
            seen[1].add(b)
    assert got == want


def test_rule_search_matches_all_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.random() < 0.4, rng.randint(0, 9) / 1.0, rng.choice([None, 0.0, 1.0, 2.0])) for _ in range(200)]
    df = spark.createDataFrame(rows, "gold boolean, x double, y double")
    got = selection.rule_search(df, "gold", ["x", "y"], 0.45, 0.1, 4).collect()
    import numpy as np

    cuts = {f: [float(np.quantile([r[k] for r in rows if r[k] is not None], p)) for p in (0.2, 0.4, 0.6, 0.8)] for k, f in ((1, "x"), (2, "y"))}
    tests = sorted({(f, s, c) for f in cuts for c in cuts[f] for s in (">=", "<=")})
    hit = lambda t, r: (v := r[1 if t[0] == "x" else 2]) is not None and (v >= t[2] if t[1] == ">=" else v <= t[2])
    found = []
    for i, a in enumerate(tests):
        for b in tests[i:]:
            m = [r[0] for r in rows if hit(a, r) and hit(b, r)]
            if m and sum(m) / len(m) >= 0.45 and sum(m) / sum(r[0] for r in rows) >= 0.1:
                name = lambda t: f"{t[0]} {t[1]} {t[2]!r}"
                found.append((-sum(m) / sum(r[0] for r in rows), -sum(m) / len(m), name(a) if a == b else f"{name(a)} and {name(b)}"))
    assert bool(found) == bool(got) and (not found or abs(min(found)[0] + got[0]["recall"]) < 1e-12 and abs(min(found)[1] + got[0]["precision"]) < 1e-12)


def test_subsets_match_all(spark):
    rng = random.Random(7)
    rows = [(g, i, rng.random(), rng.sample("abcde", 2)) for g in range(4) for i in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "g int, i long, s double, t array<string>")
    anchor = spark.createDataFrame([(0, 0.4), (1, 2.0)], "g int, least double")
    got = {r["g"]: (r["ids"], r["total"]) for r in selection.best_subset(df, "g", "i", "s", 2, "t", (1.0, 0.5), anchor).collect()}
    for g in range(4):
        least = {0: 0.4, 1: 2.0}.get(g, -1)
        options = [(sum(x[2] for x in c) / 2 + 0.5 * len({t for x in c for t in x[3]}) / 2, [x[1] for x in c]) for c in itertools.combinations([r for r in rows if r[0] == g], 2) if sum(x[2] for x in c) / 2 >= least]
        assert (g in got) == bool(options) and (not options or abs(max(o[0] for o in options) - got[g][1]) < 1e-12)


def test_group_clusters_and_gates(spark):
    from millrace.operators import pairs, splits

    rows = [(1, 0, "Ala ma kota"), (1, 1, "ala  MA kota"), (1, 2, "zupełnie inne pytanie tutaj"), (1, 3, "kota ma ala"), (2, 0, "jedno"), (3, 0, "raz dwa trzy"), (3, 1, "cztery pięć sześć"), (3, 2, "siedem osiem dziewięć")]
    df = spark.createDataFrame(rows, "g int, i int, t string").withColumn("p", F.lit("x"))
    c = splits.group_clusters(df, "g", "i", "t", 0.9)
    assert {(r["g"], r["i"]): r["cluster"] for r in c.collect()} == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (1, 3): 0, (2, 0): 0, (3, 0): 0, (3, 1): 1, (3, 2): 2}
    got = {r["g"]: r for r in pairs.diversity_gate(c, "g", "i", "t", "p", size=3, least=3).collect()}
    assert got[3]["eligible"] and got[3]["effective"] == 3 and got[3]["min_jaccard"] == 0
    assert got[1]["failures"] == ["too_few_effective", "unexpected_size"] and abs(got[1]["duplicate_rate"] - 0.25) < 1e-12
    assert "self_bleu" in got[2]["failures"] and "no_pairable" in got[2]["failures"]


def test_self_bleu(spark):
    from millrace.operators import pairs

    def want(lists):
        import math

        grams = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        total = 0.0
        for x, t in enumerate(lists):
            others = [o for y, o in enumerate(lists) if y != x]
            p = 1.0
            for k in (1, 2, 3, 4):
                p *= ((len(grams(t, k) & set().union(*(grams(o, k) for o in others))) + 1) / (len(grams(t, k)) + 1)) ** 0.25
            total += min(1.0, math.exp(1 - max(map(len, others)) / max(1, len(t)))) * p
        return total / len(lists)

    rng = random.Random(8)
    cases = [[[rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in range(n)] for n in (1, 2, 3, 4, 4)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, l array<array<string>>")
    got = {r["k"]: r["b"] for r in df.select("k", pairs.self_bleu(F.col("l")).alias("b")).collect()}
    assert got[0] is None and all(abs(got[k] - want(c)) < 1e-12 for k, c in enumerate(cases) if k)


def test_semantic_clusters(spark):
    from millrace.operators import splits

    rng = random.Random(9)
    rows = [(g, [rng.gauss(0, 1) for _ in range(3)]) for g in range(5) for _ in range(6)] + [(0, None), (0, [0.0, 0.0, 0.0])]
    got = {r["g"]: r for r in splits.semantic_clusters(spark.createDataFrame(rows, "g int, v array<double>"), "g", "v", 0.7).collect()}
    norm = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    for g in range(5):
        v = [norm(x) for k, x in rows if k == g and x and any(x)]
        root = list(range(len(v)))
        for _ in v:
            for i, j in itertools.product(range(len(v)), repeat=2):
                if sum(a * b for a, b in zip(v[i], v[j])) >= 0.7:
                    root[i] = root[j] = min(root[i], root[j])
        assert got[g]["n"] == len(v) and got[g]["clusters"] == len(set(root))


def test_near_clusters_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9002, None)], "doc_id long, text string"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    fp = {i: dedup.simhash64(t or "") for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(rows), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 3 or ((fp[i] ^ fp[j]) & (1 << 64) - 1).bit_count() <= 3:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    for r in dedup.near_clusters(docs, "doc_id", "text").collect():
        i = r["doc_id"]
        assert r["canonical"] == find(i)
        assert r["match"] == ("canonical" if find(i) == i else "exact" if rows[i] == rows[find(i)] else "near")


def test_seed_bootstrap_is_numpys(spark):
    import numpy as np

    rows = [("m", k, float(k % 5), float((k * 7) % 6)) for k in range(12)]
    r = statistics.paired_bootstrap(spark.createDataFrame(rows, "metric string, id int, l double, r double"), "metric", "l", "r", "id", 300, 1, "pcg64", (0.95,)).first()
    d, rng = np.array([x[3] - x[2] for x in rows]), np.random.default_rng(1)
    means = np.concatenate([d[rng.integers(0, 12, size=(n, 12))].mean(axis=1) for n in (256, 44)])
    assert abs(r["low_950"] - np.quantile(means, 0.025)) < 1e-12 and abs(r["difference"] - d.mean()) < 1e-12


def test_components_stay_whole(spark, sf):
    from millrace.operators import splits
    from millrace.plans import everything

    got = everything.queries()["component_splits"](spark, sf)
    assert got.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0 and got.count() > 10
    assert splits.leakage(got.where("split = 'train'"), got.where("split <> 'train'"), ["component"]).first()["shared"] == 0


def test_dense_search_takes_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0]), (4, None), (5, []), (6, [1.0, 0.0])], "id long, v array<float>")
    got = {(r["query"], r["rank"]): r["doc"] for r in retrieval.dense_scores(v, v.where("id in (1, 3, 4, 5)"), 2, "id", "v").collect()}
    assert got == {(1, 1): 1, (1, 2): 6, (3, 1): 3}
    assert retrieval.dense_scores(v, v.limit(0), 2, "id", "v").count() == 0 == retrieval.dense_scores(v.limit(0), v, 2, "id", "v").count()


def test_backfill_and_guards(spark):
    import pytest

    docs = spark.createDataFrame([(i,) for i in range(9)], "doc long")
    q = spark.createDataFrame([(1,), (2,)], "q int")
    ranked = spark.createDataFrame([(1, 3, 2.0, 1), (1, 0, 1.0, 2)], "query int, doc long, score double, rank long")
    got = sorted((r["query"], r["rank"], r["doc"]) for r in retrieval.with_backfill(ranked, q, "q", docs, 4).collect())
    assert got == [(1, 1, 3), (1, 2, 0), (1, 3, 1), (1, 4, 2), (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3)]
    with pytest.raises(ValueError):
        retrieval.checked_cutoffs((1, 20), 10)
    with pytest.raises(Exception, match="unknown document"):
        retrieval.scores_of(ranked, spark.createDataFrame([(1, 99)], "query int, doc long"), docs).collect()
    with pytest.raises(Exception, match="missing document"):
        retrieval.texts_of(docs.withColumn("t", F.lit("x")), spark.createDataFrame([(99,)], "doc long"), "doc", "t").collect()


def test_exact_groups_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "")], "i long, t string")
    got = sorted((r["i"], r["canonical"], r["group_size"]) for r in dedup.exact_groups(df, F.col("t"), "i").collect())
    assert got == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]


def test_near_pairs_by_combined_blocks(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & ((1 << 64) - 1) for b in base for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    want = {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in dedup.near_pairs(df, blocks=6).collect()} == want == {(r["a"], r["b"]) for r in dedup.near_pairs(df).collect()}


def test_components_by_rounds_and_at_once(spark, monkeypatch):
    rng = random.Random(12)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    df = spark.createDataFrame(edges, "a long, b long")
    at_once = {r["node"]: r["root"] for r in dedup.components(df).collect()}
    monkeypatch.setattr(dedup, "SMALL", 3)
    assert {r["node"]: r["root"] for r in dedup.components(df).collect()} == at_once


def test_same_cohort(spark):
    import pytest

    from millrace.operators import reports

    a, b = spark.range(3), spark.range(4)
    reports.same_cohort(a, a, "id")
    with pytest.raises(ValueError, match="missing on the left"):
        reports.same_cohort(a, b, "id")
    assert reports.fingerprint_drift({"x": a, "y": a.repartition(3), "z": b}, ["id"]) == ["z"]


def test_kept_scores_follow_all_tables(spark, sf, tmp_path):
    """After an item was rewritten its scores are new ones; without a change they are read again."""
    from millrace.plans import catalog

    docs = [(1, "red apples grow on old trees"), (2, "green pears hang in new gardens"), (3, "blue plums")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def put(item, text):
        spark.createDataFrame([(item, text)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        return sorted((r["query"], r["doc"]) for r in catalog.bm25_scores(spark, str(tmp_path)).collect())

    assert put(1, "red apples") == [(1, 1)] and put(7, "green pears") == [(7, 2)] and put(7, "blue plums") == [(7, 3)]
    again = catalog.bm25_scores(spark, str(tmp_path))
    assert again is catalog.bm25_scores(spark, str(tmp_path))


def test_containing_equals_looking_everywhere(spark):
    """Cut first and last words, short items, items without terms, repeated documents, nulls."""
    from millrace.functions import text as T

    docs = [(1, "one two three four five six seven"), (2, "none two three fourth"), (3, "two three"), (4, None), (5, "a b c d"), (6, "one two three four five six seven"), (7, "two three two three two")]
    items = [(1, "one two three"), (2, "two three four five six"), (3, "two"), (4, "b c"), (5, "missing words are here now"), (6, "three two three two"), (7, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    words = T.words(F.col("text"))
    terms = F.filter(words, lambda w: F.length(w) > 1)
    hits = retrieval.Index(d, "doc_id", terms).hits(q, "item_id", terms)
    got = sorted(map(tuple, retrieval.containing(hits, d, "doc_id", "text", q, "item_id", "text", words, terms).collect()))
    assert got == sorted((i, k) for i, t in items for k, x in docs if t is not None and x is not None and t in x)


def test_apart_finds_other_kinds_only(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.0], "a"), (3, [0.5, 0.5], "b"), (4, [0.1, 0.0], None)], "id long, v array<float>, kind string")
    got = [(r["query"], r["doc"]) for r in retrieval.dense_scores(v, v, 3, "id", "v", apart="kind").orderBy("query").collect()]
    assert got == [(1, 3), (2, 3), (3, 1), (3, 2)]


def test_pareto_front_equals_all_comparisons(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(12)), float(rng.randrange(12)), float(rng.randrange(12)) if rng.random() < 0.95 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(6)
    beats = lambda x, y: x[1] >= y[1] and x[2] >= y[2] and x[3] <= y[3] and x[1:] != y[1:]
    whole = [r for r in rows if r[3] is not None]
    want = sorted(r[0] for r in rows if r[3] is None or not any(beats(o, r) for o in whole))
    got = statistics.pareto_front(df, "id", ["a", "b"], ["c"])
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == want and statistics.pareto_front(df.limit(0), "id", ["a"]).count() == 0


def test_written_tables_can_be_cleared(spark):
    from millrace.operators import tables

    df = tables.written(spark.range(5))
    assert df.count() == 5
    tables.cleared(spark)
    import pytest

    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        df.agg(F.sum("id")).collect()
    assert tables.written(spark.range(3)).count() == 3
