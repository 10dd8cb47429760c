"""Queries of comparisons and of sliced measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import reports as P
from ..operators import retrieval, statistics
from ..operators.tables import shared_path
from .catalog import _PAIRS_SQL, _POOL_SQL, _words, conversation_pairs, poisson_sql, pools, query, rounded_interval, table
from .text_queries import lexical_focus


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity::DOUBLE), 9) AS l_quantity, round(avg(l_discount::DOUBLE), 9) AS l_discount FROM lineitem GROUP BY 1""")
def arm_summary(spark, d):
    found = P.arm_summary(table(spark, d, "lineitem").withColumns({c: F.col(c).cast("double") for c in ("l_quantity", "l_discount")}), "l_returnflag", ["l_quantity", "l_discount"])
    return found.select("l_returnflag", "n", *(F.round(c, 9).alias(c) for c in ("l_quantity", "l_discount")))


_MATCHED = "WITH a AS (SELECT p_partkey AS id, p_size::DOUBLE AS v FROM part), b AS (SELECT p_partkey AS id, p_size::DOUBLE + (p_partkey % 3) - 1 AS v FROM part), "


@query("SELECT *, CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'open' END AS verdict FROM (" + _MATCHED + poisson_sql("SELECT 'v' AS metric, id, b.v - a.v AS d FROM a JOIN b USING (id)", 50) + ")")
def matched_arms(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    b = a.withColumn("v", F.col("v") + F.col("p_partkey") % 3 - 1)
    found = P.matched_arms(a, b, "p_partkey", ["v"], 50)
    return rounded_interval(found).join(found.select("metric", "verdict"), "metric")


@query("""WITH a AS (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 HAVING max((l_tax IS NULL OR l_tax > 0.07)::INT) = 0), b AS (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING max((l_tax IS NULL OR l_tax > 0.07)::INT) = 0) SELECT l_orderkey FROM a JOIN b USING (l_orderkey)""")
def clean_groups(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", (F.col("l_tax") > 0.07).alias("risk"))
    return P.common_clean_groups([rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'")], "l_orderkey", "risk")


@query("""WITH v AS (SELECT l_orderkey AS g, l_linenumber AS s, max(l_extendedprice::DOUBLE) AS v FROM lineitem GROUP BY 1, 2 HAVING v IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, s) AS i, lead(v) OVER (PARTITION BY g ORDER BY v DESC, s) AS after, count(*) OVER (PARTITION BY g) AS n FROM v)
SELECT g, n::INT AS slots, s AS best_slot, v AS best, round(v - after, 6) AS lead FROM r WHERE i = 1""")
def slot_contrasts(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("s")).agg(F.max(F.col("l_extendedprice").cast("double")).alias("v"))
    return P.slot_contrasts(rows, "g", "s", "v").withColumn("lead", F.round("lead", 6))


@query()
def focus_variants(spark, d):
    """Focus by plain against careful sentences; the parts are tested on their own."""
    rows = conversation_pairs(spark, d)
    plain = lexical_focus(spark, d).select("conv_id", "turn", F.col("bucket").alias("a"))
    careful = rows.select("conv_id", "turn", L.lexical_focus(F.col("query"), F.col("answer"), cut=T.careful_sentences)["bucket"].alias("b"))
    return P.variant_agreement(plain.join(careful, ["conv_id", "turn"]), "a", "b")


@query("""SELECT count(*) AS n, count(*) FILTER (o_orderstatus = left(o_orderpriority, 1)) AS match, count(*) FILTER (o_orderstatus <> left(o_orderpriority, 1)) AS mismatch, count(*) FILTER (o_orderstatus IS NULL AND o_orderpriority IS NOT NULL) AS abstain_a, count(*) FILTER (o_orderstatus IS NOT NULL AND o_orderpriority IS NULL) AS abstain_b, count(*) FILTER (o_orderstatus IS NULL AND o_orderpriority IS NULL) AS abstain_both FROM orders""")
def variant_agreement(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("a"), F.left("o_orderpriority", F.lit(1)).alias("b"))
    return P.variant_agreement(rows, "a", "b")


@query("""WITH j AS (SELECT conv_id, turn, quality, count(*) OVER (PARTITION BY conv_id) AS n, max((quality IS NULL)::INT) OVER (PARTITION BY conv_id) AS m FROM conversations LEFT JOIN labels ON doc_id = conv_id * 10 + turn) SELECT conv_id, turn, quality FROM j WHERE n = 4 AND m = 0""")
def complete_scored_groups(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 10 + F.col("turn")).alias("doc_id"))
    return P.complete_scored_groups(rows, table(spark, d, "labels").select("doc_id", "quality"), "conv_id", "doc_id", 4).select("conv_id", "turn", "quality")


@query("SELECT l_returnflag, nullif(round(quantile_cont(l_extendedprice::DOUBLE, 0.75) - quantile_cont(l_extendedprice::DOUBLE, 0.25), 6), 0) AS scale FROM lineitem GROUP BY 1")
def margin_scales(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    return P.margin_scales(rows, "l_returnflag", "v").select("l_returnflag", F.round("scale", 6).alias("scale"))


@query(f"""WITH {_POOL_SQL}, r AS (SELECT o_orderpriority, o_orderstatus, len(list_filter(negatives, lambda n: n >= positive)) + 1 AS k FROM pools JOIN orders ON o_orderkey = query WHERE positive IS NOT NULL AND negatives IS NOT NULL), s AS (SELECT unnest([{{'field': 'o_orderpriority', 'value': coalesce(o_orderpriority, 'unknown')}}, {{'field': 'o_orderstatus', 'value': coalesce(o_orderstatus, 'unknown')}}]) AS s, 1.0 / k AS m FROM r) SELECT s.field AS field, s.value AS value, count(*) AS n, round(avg(m), 9) AS mean FROM s GROUP BY ALL""")
def sliced_judges(spark, d):
    """Reciprocal ranks by the slices of their orders."""
    rr = pools(spark, d).where("positive is not null").select("query", retrieval.pool_metrics(F.col("positive"), F.col("negatives"))["pool_mrr"].alias("rr"))
    rows = rr.join(table(spark, d, "orders"), F.col("query") == F.col("o_orderkey"))
    return statistics.slice_rollup(rows, ["o_orderpriority", "o_orderstatus"], "rr").withColumn("mean", F.round("mean", 9))


@query(f"""WITH t AS (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL) SELECT sha256(text) AS content, len({_words('text')})::INT AS analysis FROM t""")
def cached_analyses(spark, d):
    """Word counts through a cache: user turns first, then all turns, of which those are hits."""
    texts, cache = table(spark, d, "conversations").select("role", "text"), shared_path(spark, "analyses")
    count = lambda t: F.size(T.words(t))
    P.cached_analysis(texts.where("role = 'user'").select("text"), cache, "words", count, "int")
    return P.cached_analysis(texts.select("text"), cache, "words", count, "int")


@query(f"""WITH {_PAIRS_SQL}, m AS (SELECT conv_id, turn, NOT (query LIKE '%' || chr(10) || '%') AS f, trim(query) = '' AS e, length(answer) - length(query) AS margin, length(query) > 2000 AS risky FROM pairs)
SELECT conv_id, turn, f AND NOT e AS admissible, margin > 0 AS answerable, f AND NOT e AND margin > 0 AND NOT risky AS clean, f AND NOT e AND NOT (margin > 0 AND NOT risky) AS defective FROM m""")
def candidate_profiles(spark, d):
    q, a = F.col("query"), F.col("answer")
    flags = P.profile_flags(~q.contains("\n"), F.btrim(q) == "", F.length(a) - F.length(q), F.length(q) > 2000, F.lit(None).cast("double"))
    return conversation_pairs(spark, d).select("conv_id", "turn", *(c.alias(n) for n, c in flags.items()))


@query("""WITH r AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS r, coalesce(l_quantity::INT % 4, 0) AS rel FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rel DESC, r) AS ideal, sum((rel > 0)::INT) OVER (PARTITION BY q ORDER BY r) AS hits FROM r)
SELECT q, count(*) AS n, coalesce(max(1.0::DOUBLE / r) FILTER (rel > 0 AND r <= 5), 0) AS reciprocal_rank, round(coalesce(sum((2 ** rel - 1) / log2(r + 1)) FILTER (r <= 5) / nullif(sum((2 ** rel - 1) / log2(ideal + 1)) FILTER (ideal <= 5), 0), 0), 9) AS ndcg, round(coalesce(avg(hits::DOUBLE / r) FILTER (rel > 0), 0), 9) AS average_precision FROM p GROUP BY q""")
def graded_metrics(spark, d):
    """An order's lines by price, with grades from 0 to 3."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.row_number().over(order).alias("r"), (F.round(F.col("l_quantity")).cast("int") % 4).alias("rel"))
    found = retrieval.graded_metrics(rows, "q", "r", "rel", 5)
    return found.select("q", "n", "reciprocal_rank", F.round("ndcg", 9).alias("ndcg"), F.round("average_precision", 9).alias("average_precision"))


#: Lines of three states as three arms over suppliers.
_ARMS = (("A", "N"), ("A", "R"), ("N", "R"))
_ARM_ROWS = "a AS (SELECT l_suppkey AS id, l_returnflag AS arm, avg(l_quantity::DOUBLE) AS quantity, avg(l_discount::DOUBLE) AS discount FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1, 2)"
_ARM_DIFFS = " UNION ALL ".join(f"SELECT '{v}_minus_{c}/{m}' AS metric, x.id AS id, y.{m} - x.{m} AS d FROM a x JOIN a y ON x.id = y.id AND x.arm = '{c}' AND y.arm = '{v}'" for m in ("quantity", "discount") for c, v in _ARMS)
_COMPARED = "(WITH " + _ARM_ROWS + ", " + poisson_sql(_ARM_DIFFS, 100) + ")"


def compared(spark, d):
    rows = table(spark, d, "lineitem").where("l_suppkey is not null").select("l_suppkey", "l_returnflag", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.lit("one").alias("contract"))
    return statistics.compare_all_arms(rows, "l_returnflag", "l_suppkey", ["quantity", "discount"], _ARMS, 100, contract="contract")


@query(f"SELECT split_part(metric, '/', 1) AS comparison, split_part(metric, '/', 2) AS metric, n, difference, low, high, win_share, CASE WHEN low > 0 OR high < 0 THEN 'statistically_separated' ELSE 'inconclusive' END AS state FROM {_COMPARED}")
def three_arms(spark, d):
    """Three arms in all pairs, by one bootstrap."""
    return compared(spark, d).select("comparison", "metric", "n", *(F.round(c, 9).alias(c) for c in ("difference", "low", "high")), "win_share", "state")


@query(f"""WITH c AS (SELECT split_part(metric, '/', 1) AS comparison, max(low) FILTER (metric LIKE '%quantity') AS p, max(low) FILTER (metric LIKE '%discount') AS g, bool_or(low > 0 OR high < 0) AS apart FROM {_COMPARED} GROUP BY 1)
SELECT comparison, CASE WHEN p IS NULL OR g IS NULL THEN 'incomplete' WHEN g < -0.002 THEN 'rejected' WHEN p >= -0.5 THEN 'eligible' ELSE 'non_inferior_only' END AS status, CASE WHEN apart THEN 'statistically_separated' ELSE 'inconclusive' END AS outcome, CASE WHEN g < -0.002 THEN 'discount' ELSE '' END AS worse FROM c""")
def arm_verdicts(spark, d):
    """What the three comparisons decide: quantity must not fall by half a piece, discount is guarded."""
    found = statistics.arm_verdicts(compared(spark, d), "quantity", -0.5, {"discount": 0.002})
    return found.select("comparison", "status", "outcome", F.array_join("worse", ",").alias("worse"))
