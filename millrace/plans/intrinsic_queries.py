"""Queries of measured rows, their summaries, gates, slot predictions and review plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intrinsic as I
from ..operators.tables import written
from .catalog import _PAIRS_SQL, _content, _jaccard, conversation_pairs, query, table

#: Conversations' questions as generated queries: the answer is the passage, made-up scores by digest.
_MADE_SQL = rf"""{_PAIRS_SQL}, made AS (SELECT conv_id * 100 + turn AS id, conv_id AS "group", CASE turn % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS mode, query, answer AS passage, (length(query) % 17)::DOUBLE AS positive, list_transform(range(1, 6), lambda k: ((length(answer) * k) % 19)::DOUBLE) AS negatives,
    (length(query) % 11)::DOUBLE AS sp, list_transform(range(1, 6), lambda k: ((length(answer) * k) % 13)::DOUBLE) AS sn, CASE WHEN conv_id % 4 > 0 THEN (length(query) * length(answer)) % 150 + 1 END AS rank FROM pairs WHERE query IS NOT NULL AND answer IS NOT NULL)"""


def made(spark, d):
    q, a = F.length("query"), F.length("answer")
    scores = lambda m: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: ((a * k) % m).cast("double"))
    rows = conversation_pairs(spark, d).where("query is not null and answer is not null")
    return rows.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("group"), F.when(F.col("turn") % 3 == 0, "a").when(F.col("turn") % 3 == 1, "b").alias("mode"), "query", F.col("answer").alias("passage"), F.col("query").alias("reference"),
        (q % 17).cast("double").alias("positive"), scores(19).alias("negatives"), (q % 11).cast("double").alias("shadow_positive"), scores(13).alias("shadow_negatives"), F.when(F.col("conv_id") % 4 > 0, (q * a) % 150 + 1).alias("corpus_rank"),
    )


_MEASURED_SQL = f"""{_MADE_SQL}, ranks AS (SELECT *, 1 + len(list_filter(negatives, lambda n: n >= positive)) AS pr, positive - list_max(negatives) AS margin, 1 + len(list_filter(sn, lambda n: n >= sp)) AS sr FROM made),
measured AS (SELECT id, "group", coalesce(mode, 'unknown') AS mode, query, pr, margin, sr, rank, {_jaccard(f"list_distinct({_content('query')})", f"list_distinct({_content('passage')})", 0.0)} AS cj, 1.0 / pr AS mrr, CASE WHEN rank IS NOT NULL THEN (rank <= 20)::INT::DOUBLE END AS rt20 FROM ranks)"""


@query(f"WITH {_MEASURED_SQL} SELECT id, pr AS pool_rank, margin AS pool_margin, pr <> sr AS judge_rank_disagreement, cj AS content_jaccard, cj AS natural_content_jaccard, rt20 AS round_trip_at_20, 1.0::DOUBLE AS reference_focus_agreement FROM measured")
def intrinsic_rows(spark, d):
    """The reference is the query itself, so that both agree in focus and likeness."""
    return I.intrinsic_rows(made(spark, d)).select("id", "pool_rank", "pool_margin", "judge_rank_disagreement", "content_jaccard", "natural_content_jaccard", "round_trip_at_20", "reference_focus_agreement")


_SPREAD = ", ".join(f"round(quantile_cont(v, {p}), 9) AS {n}" for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95)))


@query(f"""WITH {_MEASURED_SQL}, l AS (SELECT mode, 'pool_margin' AS metric, margin AS v FROM measured UNION ALL SELECT mode, 'content_jaccard', cj FROM measured)
SELECT mode, metric, count(*) AS n, round(avg(v), 9) AS mean, {_SPREAD} FROM l GROUP BY 1, 2 UNION ALL SELECT mode, 'pool_mrr', count(*), round(avg(mrr), 9), NULL, NULL, NULL FROM measured GROUP BY 1 UNION ALL SELECT mode, 'round_trip_at_20', count(rt20), round(avg(rt20), 9), NULL, NULL, NULL FROM measured WHERE rt20 IS NOT NULL GROUP BY 1""")
def mode_summaries(spark, d):
    found = I.mode_summaries(I.intrinsic_rows(made(spark, d)), spread=("pool_margin", "content_jaccard"), rates=("pool_mrr", "round_trip_at_20"))
    return found.select("mode", "metric", "n", *(F.round(c, 9).alias(c) for c in ("mean", "p05", "p50", "p95")))


@query(f"""WITH {_MEASURED_SQL}, f AS (SELECT "group", id, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+') AS w, lower(trim(query)) AS form FROM measured), g AS (SELECT "group", count(*)::INT AS n, 1 - count(DISTINCT form)::DOUBLE / count(*) AS d FROM f GROUP BY 1) SELECT "group", n, round(d, 9) AS duplicate_rate FROM g""")
def group_measures(spark, d):
    """Sizes and duplicates by group; the other measures are held against plain Python in the tests."""
    found = I.group_measures(I.intrinsic_rows(made(spark, d)), ["group"])
    return found.select("group", "n", F.round("duplicate_rate", 9).alias("duplicate_rate"))


@query()
def focus_summary(spark, d):
    """Where questions aim by mode; against plain Python in the tests."""
    found = I.focus_summary(I.intrinsic_rows(made(spark, d)))
    return found.select("mode", "n", *(F.round(c, 9).alias(c) for c in ("first_sentence_share", "bucket_entropy", "sentence_gini")), F.array_join(F.transform("buckets", lambda b: F.concat_ws(":", b["bucket"], b["c"].cast("string"))), ",").alias("buckets"))


@query(f"""WITH s AS (SELECT unnest([{{'field': 'l_returnflag', 'value': coalesce(l_returnflag, 'unknown')}}, {{'field': 'l_shipmode', 'value': coalesce(l_linestatus, 'unknown')}}]) AS s, l_quantity::DOUBLE AS q, l_tax::DOUBLE AS t FROM lineitem), l AS (SELECT s.field AS field, s.value AS value, 'q' AS metric, q AS v FROM s UNION ALL SELECT s.field, s.value, 't', t FROM s)
SELECT field, value, metric, count(*) AS count, count(v) AS n, round(avg(v), 9) AS mean, {_SPREAD} FROM l GROUP BY 1, 2, 3""")
def slice_distributions(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_linestatus").alias("l_shipmode"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    found = I.slice_distributions(rows, ["l_returnflag", "l_shipmode"], ["q", "t"])
    return found.select("field", "value", "metric", "count", "n", *(F.round(c, 9).alias(c) for c in ("mean", "p05", "p50", "p95")))


#: Orders with at least four lines as groups; the first four lines are an arm's rows.
_GATE = """r AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_discount::DOUBLE AS disc, l_tax::DOUBLE AS tax, l_quantity::DOUBLE AS q FROM lineitem WHERE l_orderkey IS NOT NULL),
k AS (SELECT g FROM r GROUP BY g HAVING count(*) >= 4), f AS (SELECT r.* FROM r JOIN k ON r.g = k.g WHERE i <= 4)"""


@query(f"""WITH {_GATE}, a AS (SELECT avg((disc > 0.08)::INT) AS b, avg((tax > 0.07)::INT) AS v FROM f), p AS (SELECT g, max((disc > 0.08)::INT) + max((tax > 0.07)::INT) AS m FROM f GROUP BY g)
SELECT 'baseline_natural_tail' AS guardrail, CASE WHEN b <= 0.2 THEN 'passed' ELSE 'failed' END AS status, round(b, 9) AS value FROM a UNION ALL SELECT 'variant_natural_tail', CASE WHEN v <= 0.2 THEN 'passed' ELSE 'failed' END, round(v, 9) FROM a
UNION ALL SELECT 'common_clean_groups', CASE WHEN avg((m = 0)::INT) >= 0.1 THEN 'passed' ELSE 'failed' END, round(avg((m = 0)::INT), 9) FROM p""")
def quality_gate(spark, d):
    """Rates of risk and clean groups; bounds by bootstrap are held against compare_arms in the tests."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, d, "lineitem").where("l_orderkey is not null").withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))).where("n >= 4 and i <= 4")
    lines = written(lines.select("l_orderkey", "i", "l_discount", "l_tax"), "gate-lines")
    arm = lambda risk: lines.select(F.col("l_orderkey").alias("g"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("i").cast("string")).alias("id"), risk.alias("risk"), F.lit(2).alias("clusters"), F.lit(0.5).alias("cosine"))
    found = I.quality_gate(arm(F.col("l_discount").cast("double") > 0.08), arm(F.col("l_tax").cast("double") > 0.07), 0.15, "g", "id", "risk", ("clusters", "cosine"), {"tail": 0.05, "risk": 0.05, "clean": 0.1, "clusters": 0.1, "cosine": 0.1}, 50)
    return found.where("guardrail in ('baseline_natural_tail', 'variant_natural_tail', 'common_clean_groups')").select("guardrail", "status", F.round("value", 9).alias("value"))


@query("""WITH e AS (SELECT vec_id // 8 AS g, vec_id % 8 AS s, vec_id AS v, coalesce(label, 0) AS l FROM embeddings), w AS (SELECT g FROM e GROUP BY g HAVING count(*) = 8 AND count(DISTINCT s) = 8), x AS (SELECT e.g AS g, max(CASE WHEN s = 5 THEN v % 7 + 3 END) > max(CASE WHEN s <> 5 THEN v % 7 END) AS p1, max(CASE WHEN s = 4 THEN l END) AS u, max(CASE WHEN s = 0 THEN l END) AS o, max(CASE WHEN s = 3 THEN v % 5 END) < max(CASE WHEN s = 0 THEN v % 5 END) AS p2, max(CASE WHEN s = 7 THEN (v % 3 > 0)::INT END) = 0 AS p4 FROM e JOIN w ON e.g = w.g GROUP BY 1)
SELECT 'P1' AS prediction, count(*) FILTER (p1) AS hits, 0 AS ties, count(*) AS n FROM x UNION ALL SELECT 'P2', count(*) FILTER (p2), 0, count(*) FROM x UNION ALL SELECT 'P4_wrong_form', count(*) FILTER (p4), 0, count(*) FROM x UNION ALL SELECT 'P8a', count(*) FILTER (u < o), count(*) FILTER (u = o), count(*) FROM x""")
def slot_predictions(spark, d):
    """Groups of eight vectors with made-up measures; the other predictions are held against plain Python in the tests."""
    v, s = F.col("vec_id"), F.col("vec_id") % 8
    near = F.when(s == 5, v % 7 + 3).otherwise(v % 7).cast("double")
    rows = table(spark, d, "embeddings").select(
        F.floor(v / 8).alias("group"), s.alias("slot"), F.concat(F.lit("q "), v.cast("string")).alias("query"), near.alias("copy_density"), near.alias("longest_copied"), (v % 5).cast("double").alias("content_jaccard"), (v % 5).cast("double").alias("entity_preservation"),
        F.lit("middle").alias("declared_focus"), F.lit("end").alias("focus"), (v % 3 > 0).alias("format_valid"), F.lit("x").alias("declared_form"), F.lit("x").alias("style"), F.lit(True).alias("eligible"), F.coalesce("label", F.lit(0)).alias("score"), F.lit(0).alias("shadow_score"), F.lit(0).alias("round_trip"),
    )
    return I.slot_predictions(rows, {"P1": 0.5}).where("prediction in ('P1', 'P2', 'P4_wrong_form', 'P8a')").select("prediction", "hits", "ties", "n")


_BLIND = f"""{_PAIRS_SQL}, b AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS id, answer, query AS a, query || ' ?' AS b FROM pairs WHERE trim(query) <> '' AND trim(answer) <> ''), o AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 5 AS batch FROM b)"""


def blind(spark, d):
    rows = conversation_pairs(spark, d).where("trim(query) <> '' and trim(answer) <> ''")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return rows.select(key.alias("audit_id"), F.col("answer").alias("passage"), F.col("query").alias("query_a"), F.concat("query", F.lit(" ?")).alias("query_b"), F.sha2(key, 256).alias("orientation_commitment"))


@query(f"WITH {_BLIND} SELECT model, batch, string_agg(id, ',' ORDER BY id) AS items, count(*)::INT * 40 + extra AS max_tokens FROM o, (VALUES ('m1', 0), ('m2', 25)) AS m(model, extra) GROUP BY model, extra, batch")
def review_plan(spark, d):
    """Every pair by both models, five pairs a request."""
    found = I.review_plan(blind(spark, d), {"m1": 0, "m2": 25}, 5, 40, "v1")
    return found.select("model", "batch", F.array_join("item_ids", ",").alias("items"), "max_tokens")


@query(f"WITH {_BLIND} SELECT model, (SELECT count(DISTINCT batch) FROM o) AS requests, (SELECT count(*) FROM o) AS ratings FROM (VALUES ('m1'), ('m2')) AS m(model)")
def review_totals(spark, d):
    return I.plan_summary(I.review_plan(blind(spark, d), {"m1": 0, "m2": 25}, 5, 40, "v1"))
