"""Packages with planted faults; a journal that a killed stream goes on writing; subsets and comparisons against plain Python."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import handoff, retrieval, selection, statistics
from millrace.streaming import journal as J

P = "preference_id string, place long, split string, prompt string, chosen string, chosen_id string, passage_id string, cluster_id string, provenance string"
C = "preference_id string, place long, prompt string, completion string, candidate_id string, passage_id string, cluster_id string, split string, provenance string"
W = "preference_id string, place long, split string, provenance string, weight_policy string, sample_weight double"


def package(n=6):
    split = lambda k: "train" if k < n - 2 else "dev"
    p = [(f"i{k}", k, split(k), f"q{k}", f"c{k}", f"id{k}", f"p{k}", f"g{k}", "v") for k in range(n)]
    c = [(i, k, q, c_, d, pa, g, s, v) for i, k, s, q, c_, d, pa, g, v in p]
    w = [(i, k, s, v, "w1", 1.0) for i, k, s, _, _, _, _, _, v in p]
    return p, c, w



def test_handoff_finds_planted_faults(spark):
    def faults(p, c, w):
        out = handoff.handoff_faults(spark.createDataFrame(p, P), spark.createDataFrame(c, C), spark.createDataFrame(w, W), "w1")
        return sorted(map(tuple, out.collect()))

    p, c, w = package()
    put = lambda rows, at, col, v: [r[:col] + (v,) + r[col + 1 :] if k == at else r for k, r in enumerate(rows)]
    assert faults(p, c, w) == []
    swap = put(put(c, 1, 1, 2), 2, 1, 1)
    assert faults(p, swap, w) == [("i1", "control_order"), ("i2", "control_order")]
    assert faults(p, c, put(put(w, 0, 1, 3), 3, 1, 0)) == [("i0", "weight_order"), ("i3", "weight_order")]
    assert faults(p, c[:-1], w) == [("i5", "missing_control")] and faults(p, c, w[:-1]) == [("i5", "missing_weight")]
    assert faults(p[:-1], c, w) == [("i5", "orphan_control"), ("i5", "orphan_weight")]
    assert faults(p, put(c, 0, 3, "x"), w) == [("i0", "control_completion")] and faults(p, put(c, 5, 8, None), w) == [("i5", "control_provenance")]
    assert faults(p, c, put(w, 4, 4, None)) == [("i4", "weight_policy")] and faults(p, c, put(w, 4, 5, -1.0)) == [("i4", "bad_weight")] == faults(p, c, put(w, 4, 5, float("nan")))
    assert faults(put(p, 5, 6, "p0"), put(c, 5, 5, "p0"), w) == [("p0", "passage_leak")]
    assert ("i2", "duplicate_weight") in faults(p, c, [*w, (*w[2][:1], 99, *w[2][2:])])
    got = handoff.packaged(spark.createDataFrame(c, C), spark.createDataFrame(w, W))
    assert got.count() == 6 and {"sample_weight", "weight_policy", "completion"} <= set(got.columns)


def test_killed_batch_is_written_once(spark, tmp_path):
    """The second batch dies after it was written and before the stream noted it; the restart replaces it and goes on."""
    source, path = tmp_path / "in", f"file://{tmp_path}/journal"
    cohort = spark.range(30).select(F.col("id").alias("place"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("item"))
    J.claimed(spark, path, {"run": 1})
    assert J.journal(spark, path, "place long, item string").count() == 0
    died = []

    def build(df):
        return df.withColumn("item", F.upper("item"))

    def feed(lo, hi):
        cohort.where(f"place >= {lo} and place < {hi}").coalesce(1).write.mode("append").parquet(str(source))

    def run(kill_at=None):
        stream = spark.readStream.schema(cohort.schema).option("maxFilesPerTrigger", 1).parquet(str(source))

        def deadly(df):
            out = build(df)
            if kill_at is not None and df.where(f"place = {kill_at}").count():
                out.write.mode("overwrite").parquet(f"{path}/batch=1")
                died.append(1)
                raise RuntimeError("killed")
            return out

        q = J.journal_writer(stream, path, deadly).trigger(availableNow=True).start()
        q.awaitTermination(120)

    feed(0, 10)
    run()
    feed(10, 20)
    with pytest.raises(Exception, match="killed"):
        run(kill_at=15)
    assert died
    feed(20, 25)
    run()
    rows = J.journal(spark, path, "place long, item string")
    assert sorted((r["place"], r["item"]) for r in rows.collect()) == [(k, f"R{k}") for k in range(25)]
    J.claimed(spark, path, {"run": 1})
    assert sorted(r["place"] for r in J.resumed(cohort.withColumn("item", F.upper("item")), rows, "item", "place").collect()) == list(range(25, 30))
    with pytest.raises(ValueError, match="another run"):
        J.claimed(spark, path, {"run": 2})
    J.claimed(spark, path, {"run": 2}, archive=f"file://{tmp_path}/old")
    assert J.journal(spark, path, "place long, item string").count() == 0 and J.journal(spark, f"file://{tmp_path}/old", "place long, item string").count() == 25


@pytest.mark.parametrize("done,fault", [([(0, "a"), (0, "a")], "repeated at a"), ([(0, "x")], "strange at x"), ([(1, "a"), (0, "b")], "moved at"), ([(0, "a"), (2, "c")], "gap at 2")])
def test_a_journal_must_be_the_cohorts_beginning(spark, done, fault):
    cohort = spark.createDataFrame([(k, c) for k, c in enumerate("abcd")], "place long, item string")
    with pytest.raises(ValueError, match=fault):
        J.resumed(cohort, spark.createDataFrame(done, "place long, item string"), "item", "place")
    assert J.resumed(cohort, cohort.limit(0), "item", "place").count() == 4


def test_feasible_subsets_equal_all_combinations(spark):
    rng, rows, want = random.Random(6), [], {}
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    for g in range(25):
        group = [{"id": f"{g}-{k}", "anchor": k % 2 == 0, "risk": rng.random() < 0.3, "density": rng.random(), "excess": rng.gauss(0, 1), "eff": rng.randrange(1, 500), "terms": rng.sample("abcdefgh", rng.randrange(0, 5)), "v": unit([rng.gauss(0, 1) for _ in range(6)]), "m1": rng.random(), "m2": rng.choice([0.0, 1.0])} for k in range(8)]
        rows += [(g, c["id"], c["anchor"], c["risk"], c["density"], c["excess"], c["eff"], 1000, c["terms"], c["v"], c["m1"], c["m2"]) for c in group]
        anchor, best = [c for c in group if c["anchor"]], None
        mean = lambda xs: math.fsum(xs) / len(xs)
        for s in itertools.combinations(group, 4):
            if sum(c["risk"] for c in s) > sum(c["risk"] for c in anchor) or any(mean([c[m] for c in s]) + 1e-12 < mean([c[m] for c in anchor]) for m in ("m1", "m2")):
                continue
            pairs = list(itertools.combinations(s, 2))
            cosine = mean([sum(x * y for x, y in zip(a["v"], b["v"])) for a, b in pairs])
            lexical = 1 - mean([len({*a["terms"]} & {*b["terms"]}) / len({*a["terms"]} | {*b["terms"]}) if a["terms"] or b["terms"] else 1.0 for a, b in pairs])
            score = 0.3 * mean([math.exp(-abs(c["excess"]) / 0.7) for c in s]) + 0.25 * min(1, max(0, 1 - cosine)) + 0.2 * lexical + 0.15 * mean([1 - math.log1p(c["eff"]) / math.log1p(1000) for c in s]) + 0.1 * (1 - mean([c["density"] for c in s]))
            if best is None or score > best[1] + 1e-12:
                best = [c["id"] for c in s], score
        want[g] = best
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, id string, anchor boolean, copy_risk boolean, copy_density double, margin_excess double, n_effective long, n_corpus long, terms array<string>, vector array<double>, m1 double, m2 double")
    found = selection.feasible_subsets(df, "g", "id", ["m1", "m2"], 0.7)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    got = {r["g"]: r for r in found.collect()}
    for g, (ids, score) in want.items():
        assert got[g]["ids"] == ids and abs(got[g]["score"] - score) < 1e-9 and got[g]["changed"] == (ids != [f"{g}-{k}" for k in (0, 2, 4, 6)])
    with pytest.raises(Exception, match="not 8 candidates"):
        selection.feasible_subsets(df.where("id <> '0-1'"), "g", "id", ["m1"], 0.7).collect()


def test_graded_metrics_of_known_lists(spark):
    lists = {"a": [3, 2, 0, 1], "b": [0, 0, 0], "c": [0, 1, 3], "d": [1] * 12, "e": [0] * 10 + [3]}
    df = spark.createDataFrame([(g, k + 1, v) for g, vs in lists.items() for k, v in enumerate(vs)], "g string, r int, rel int")
    got = {r["g"]: r for r in retrieval.graded_metrics(df, "g", "r", "rel", 10).collect()}
    dcg = lambda vs: sum((2**v - 1) / math.log2(k + 2) for k, v in enumerate(vs[:10]))
    for g, vs in lists.items():
        ideal = dcg(sorted(vs, reverse=True))
        hits = [sum(v > 0 for v in vs[: k + 1]) / (k + 1) for k, v in enumerate(vs) if v > 0]
        assert got[g]["ndcg"] == pytest.approx(dcg(vs) / ideal if ideal else 0) and got[g]["average_precision"] == pytest.approx(sum(hits) / len(hits) if hits else 0)
        assert got[g]["reciprocal_rank"] == pytest.approx(next((1 / (k + 1) for k, v in enumerate(vs[:10]) if v > 0), 0))


def test_compared_arms_share_their_draws(spark):
    rng = random.Random(1)
    rows = [(a, k, x + {"x": 0.0, "y": 1.0, "z": 1.0}[a], "f") for k in range(200) for x in [rng.gauss(0, 1)] for a in "xyz"]
    df = spark.createDataFrame(rows, "arm string, id long, m double, frozen string")
    found = statistics.compare_all_arms(df, "arm", "id", ["m"], [("x", "y"), ("x", "z"), ("y", "z")], 100, contract="frozen")
    got = {r["comparison"]: r for r in found.collect()}
    assert got["y_minus_x"]["low"] == pytest.approx(got["z_minus_x"]["low"]) and got["z_minus_y"]["high"] == pytest.approx(0, abs=1e-9)
    single = statistics.compare_arms(df.where("arm = 'x'"), df.where("arm = 'y'"), "id", ["m"], 100).first()
    assert (single["low"], single["high"]) == pytest.approx((got["y_minus_x"]["low"], got["y_minus_x"]["high"]))
    verdicts = {r["comparison"]: r["status"] for r in statistics.arm_verdicts(found, "m", 0.5, {}).collect()}
    assert verdicts == {"y_minus_x": "eligible", "z_minus_x": "eligible", "z_minus_y": "non_inferior_only"}
    assert {r["status"] for r in statistics.arm_verdicts(found, "m", 0.5, {"other": 0.1}).collect()} == {"incomplete"}
    with pytest.raises(ValueError, match="arms differ in frozen"):
        statistics.compare_all_arms(df.withColumn("frozen", F.col("arm")), "arm", "id", ["m"], [("x", "y")], 10, contract="frozen")
    assert json.loads(J.identity_of({"b": 1, "a": "ł"})) == {"a": "ł", "b": 1}
