"""Measured rows, groups, gates, predictions and review plans against plain Python."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import intrinsic as I
from millrace.operators import statistics

ROW = "id long, `group` long, mode string, query string, passage string, reference string, positive double, negatives array<double>, requested_form string, requested_focus string"


def test_rows_without_optional_inputs(spark):
    rows = [(1, 1, None, "where do the old mills stand", "The old mills stand by the river. They grind.", "old mills", 3.0, [1.0, 3.0], "full_question", "beginning"), (2, 1, None, "", "", None, 1.0, [], None, None)]
    got = {r["id"]: r for r in I.intrinsic_rows(spark.createDataFrame(rows, ROW)).collect()}
    a = got[1]
    assert a["pool_rank"] == 2 and a["pool_margin"] == 0 and a["shadow_pool_rank"] is None and a["judge_rank_disagreement"] is None and a["round_trip_at_5"] is None
    assert a["form_accuracy"] in (0.0, 1.0) and a["intent_accuracy"] is None and a["focus_accuracy"] in (0.0, 1.0) and got[2]["form_accuracy"] is None and got[2]["empty"]
    assert I.intrinsic_rows(spark.createDataFrame([], ROW)).count() == 0
    assert {r["mode"] for r in I.mode_summaries(I.intrinsic_rows(spark.createDataFrame(rows, ROW))).collect()} == {"unknown"}


def bits(values):
    n = Counter(values)
    return -sum(c / len(values) * math.log2(c / len(values)) for c in n.values())


def test_group_and_focus_measures(spark):
    rng = random.Random(3)
    rows = [(g, k, " ".join(rng.choices(["mill", "river", "stone", "old", "wheel"], k=rng.randrange(1, 5))), rng.choice(["x", "y"]), rng.choice(["beginning", "end", None]), rng.choice([0, 1, 2, None])) for g in range(12) for k in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "g long, id long, query string, predicted_style string, predicted_focus string, predicted_sentence int").withColumn("mode", F.lit(None).cast("string"))
    got = {r["g"]: r for r in I.group_measures(df, ["g"]).collect()}
    for g in got:
        mine = sorted(r for r in rows if r[0] == g)
        toks = [r[2].split() for r in mine]
        one, two = [t for ts in toks for t in ts], [p for ts in toks for p in sorted(set(zip(ts, ts[1:])))]
        pairs = [len({*a} & {*b}) / len({*a} | {*b}) for a, b in itertools.combinations(toks, 2)]
        r = got[g]
        assert r["n"] == len(mine) and r["distinct_1"] == pytest.approx(len(set(one)) / len(one)) and (r["distinct_2"] is None if not two else r["distinct_2"] == pytest.approx(len(set(two)) / len(two)))
        assert (r["mean_jaccard"] is None) == (not pairs) and (not pairs or (r["mean_jaccard"] == pytest.approx(sum(pairs) / len(pairs)) and r["max_jaccard"] == max(pairs)))
        assert r["duplicate_rate"] == pytest.approx(1 - len({x[2] for x in mine}) / len(mine)) and r["style_entropy"] == pytest.approx(bits([x[3] for x in mine])) and r["focus_entropy"] == pytest.approx(bits([x[4] for x in mine]))
    f = I.focus_summary(df).first()
    places = sorted(Counter(r[5] for r in rows if r[5] is not None).values())
    n, total = len(places), sum(places)
    assert f["n"] == len(rows) and f["first_sentence_share"] == pytest.approx(sum(r[5] == 0 for r in rows) / len(rows)) and f["bucket_entropy"] == pytest.approx(bits([r[4] or "none" for r in rows]))
    assert f["sentence_gini"] == pytest.approx(2 * sum((i + 1) * c for i, c in enumerate(places)) / (n * total) - (n + 1) / n)


def test_slices_add_up(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2] if k % 5 else None, float(k) if k % 3 else None) for k in range(40)], "id long, s string, m double")
    rows = I.slice_distributions(df, ["s"], ["m"]).collect()
    assert {r["value"] for r in rows} == {"a", "b", "unknown"} and sum(r["count"] for r in rows) == 40 and sum(r["n"] for r in rows) == sum(k % 3 > 0 for k in range(40))


def test_quality_gate_passes_and_stops(spark):
    arm = lambda risk, clusters: spark.createDataFrame([(g, f"{g}-{k}", risk(g, k), clusters + g % 2, 0.5) for g in range(60) for k in range(4)], "g long, id string, risk boolean, clusters int, cosine double")
    limits = {"tail": 0.05, "risk": 0.02, "clean": 0.5, "clusters": 0.2, "cosine": 0.05}
    gate = lambda a, b: {r["guardrail"]: r for r in I.quality_gate(a, b, 0.1, "g", "id", "risk", ("clusters", "cosine"), limits, 100).collect()}
    low = arm(lambda g, k: g % 10 == 0 and k == 0, 2)
    same = gate(low, low)
    assert same["decision"]["status"] == "continue" and same["common_clean_groups"]["value"] == pytest.approx(0.9)
    worse = gate(low, arm(lambda g, k: k == 0, 2))
    assert worse["decision"]["status"] == "stop" and worse["variant_natural_tail"]["status"] == worse["variant_vs_baseline"]["status"] == worse["common_clean_groups"]["status"] == worse["clusters"]["status"] == "failed"
    fewer = gate(low, arm(lambda g, k: g % 10 == 0 and k == 0, 1))
    found = statistics.compare_arms(low.groupBy("g").agg(F.max("clusters").alias("c")), low.groupBy("g").agg((F.max("clusters") - 1).alias("c")), "g", ["c"], 100).first()
    assert fewer["clusters"]["value"] == found["low"] == -1 and fewer["clusters"]["status"] == "failed"
    with pytest.raises(ValueError, match="arms differ"):
        gate(low, low.where("id <> '3-1'"))


def test_slot_predictions(spark):
    schema = "`group` long, slot int, query string, copy_density double, longest_copied double, content_jaccard double, entity_preservation double, declared_focus string, focus string, format_valid boolean, declared_form string, style string, eligible boolean, score double, shadow_score double, round_trip double"

    def group(g, **change):
        rows = {k: [g, k, f"query {k}", 0.1, 1.0, 0.5, 1.0, "end", "end", True, "f", "f", True, 5.0, 5.0, 1.0] for k in range(8)}
        rows[2][2], rows[5][3:5], rows[3][5:7], rows[6][8], rows[7][9], rows[4][13:15], rows[3][15] = "Query  0", [0.9, 9.0], [0.1, 0.5], "middle", False, [1.0, 1.0], 0.0
        for at, v in change.items():
            slot, col = map(int, at[1:].split("_"))
            rows[slot][col] = v
        return [tuple(r) for r in rows.values()]

    rows = group(1) + group(2, _5_3=0.1, _3_15=1.0, _0_12=False) + group(3, _4_13=5.0, _0_7=None, _1_9=False) + group(4)[:7]
    got = {r["prediction"]: r for r in I.slot_predictions(spark.createDataFrame(rows, schema), {"P1": 0.9, "P2": 1.0}).collect()}
    said = lambda p: (got[p]["hits"], got[p]["ties"], got[p]["n"])
    assert said("P1") == (2, 0, 3) and got["P1"]["passed"] is False and said("P2") == (3, 0, 3) and got["P2"]["passed"] is True and got["P3_good"]["passed"] is None
    assert said("P3_wrong_focus") == (3, 0, 3) and said("P3_good") == (2, 0, 2) and said("P4_wrong_form") == (3, 0, 3) and said("P4_good") == (8, 0, 9) and said("P5") == (9, 0, 9)
    assert said("P6") == (3, 0, 3) and said("P7") == (2, 0, 3) and said("P8a") == (2, 1, 3) and said("P8a_shadow") == (3, 0, 3) and said("P8b") == (2, 1, 3)


def test_review_plan_refuses_leaks(spark):
    rows = [(f"a{k:02}", "p", f"x{k}", f"y{k}", "c") for k in range(13)]
    df = spark.createDataFrame(rows, "audit_id string, passage string, query_a string, query_b string, orientation_commitment string")
    plan = I.review_plan(df, {"m": 0, "n": 7}, 5, 10, "v1", 13).orderBy("model", "batch").collect()
    assert [(r["model"], len(r["item_ids"]), r["max_tokens"]) for r in plan] == [("m", 5, 50), ("m", 5, 50), ("m", 3, 30), ("n", 5, 57), ("n", 5, 57), ("n", 3, 37)] and plan[0]["item_ids"] == [f"a{k:02}" for k in range(5)]
    assert len({r["request_id"] for r in plan}) == 6
    for bad in (df.withColumn("margin", F.lit(1)), df.drop("passage"), df.withColumn("query_b", F.col("query_a")), df.union(df), df.withColumn("passage", F.lit(" "))):
        with pytest.raises(ValueError, match="blind pairs"):
            I.review_plan(bad, {"m": 0}, 5, 10, "v1")
    with pytest.raises(ValueError, match="13 blind pairs"):
        I.review_plan(df, {"m": 0}, 5, 10, "v1", 12)


def test_quality_gate_reads_each_arm_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def risk(i):
        seen.add(1)
        return i % 7 == 0

    arm = spark.range(40).select((F.col("id") % 10).alias("g"), F.col("id"), risk.asNondeterministic()("id").alias("risk"), F.lit(2).alias("clusters"), F.lit(0.5).alias("cosine"))
    limits = {"tail": 0.05, "risk": 0.02, "clean": 0.1, "clusters": 0.2, "cosine": 0.05}
    found = {r["guardrail"]: r["value"] for r in I.quality_gate(arm, arm, 0.1, "g", "id", "risk", ("clusters", "cosine"), limits, 20).collect()}
    assert seen.value == 80 and found["baseline_natural_tail"] == found["variant_natural_tail"] == 6 / 40 and found["common_clean_groups"] == 0.4
