"""Queries of tests, intervals, agreement and decisions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import statistics as S
from .catalog import _RATED_SQL, poisson_sql, query, rated, rounded_interval, table

_RUNS_SQL = "runs AS (SELECT l_returnflag AS metric, l_suppkey % 12 AS seed, avg(l_quantity::DOUBLE) FILTER (l_linenumber = 1) AS l, avg(l_quantity::DOUBLE) FILTER (l_linenumber = 2) AS r FROM lineitem WHERE l_returnflag IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1, 2)"


def _runs(spark, d):
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    return table(spark, d, "lineitem").where("l_returnflag is not null and l_suppkey is not null").groupBy(F.col("l_returnflag").alias("metric"), (F.col("l_suppkey") % 12).alias("seed")).agg(F.avg(F.when(n == 1, q)).alias("l"), F.avg(F.when(n == 2, q)).alias("r"))


@query(f"""WITH {_RUNS_SQL}, d AS (SELECT metric, list(r - l ORDER BY seed) AS d FROM runs WHERE r - l IS NOT NULL GROUP BY metric),
f AS (SELECT metric, d, m, list_sum(list_transform(range(len(d)), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN -d[i + 1] ELSE d[i + 1] END)) AS s FROM d, unnest(range((2 ** len(d))::BIGINT)) AS u(m))
SELECT metric, any_value(len(d))::BIGINT AS n, round(any_value(list_sum(d)) / any_value(len(d)), 9) AS difference, avg((s >= list_sum(d) - 1e-9)::INT) AS p FROM f GROUP BY metric""")
def sign_flips(spark, d):
    return S.sign_flip(_runs(spark, d), "metric", "l", "r", "seed").withColumn("difference", F.round("difference", 9))


@query("""WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS wins, count(*) FILTER (l_returnflag = 'A') AS losses FROM lineitem GROUP BY 1)
SELECT l_suppkey, wins, losses, round(least(1, 2 * list_sum(list_transform(range(least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))), 9)::DOUBLE AS p FROM c""")
def sign_tests(spark, d):
    count = lambda x: F.sum(F.when(F.col("l_returnflag") == x, 1).otherwise(0))
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(count("R").alias("wins"), count("A").alias("losses"))
    return rows.withColumn("p", F.round(S.sign_test(F.col("wins"), F.col("losses")), 9))


@query("WITH " + poisson_sql("SELECT l_returnflag AS metric, l_orderkey AS id, (avg(l_quantity::DOUBLE) > 25)::INT AS d FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1, 2", 20))
def proportion_intervals(spark, d):
    """The share of orders with more than 25 on average."""
    rows = table(spark, d, "lineitem").where("l_returnflag is not null").groupBy(F.col("l_returnflag").alias("metric"), "l_orderkey").agg((F.avg(F.col("l_quantity").cast("double")) > 25).cast("int").alias("hit"))
    return rounded_interval(S.poisson_bootstrap(rows.withColumn("zero", F.lit(0)), "metric", "zero", "hit", "l_orderkey", 20))


_Z = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)


@query(f"SELECT o_orderpriority, count(o_totalprice) AS n, round({_Z!r}::DOUBLE * stddev_samp(o_totalprice::DOUBLE) / sqrt(count(o_totalprice)), 6) AS effect FROM orders GROUP BY 1")
def detectable_effects(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("o_totalprice").alias("n"), F.stddev_samp(F.col("o_totalprice").cast("double")).alias("sd"))
    return g.select("o_orderpriority", "n", F.round(S.detectable(F.col("sd"), F.col("n")), 6).alias("effect"))


@query("SELECT c_nationkey, count(c_acctbal) AS n, round(avg(c_acctbal::DOUBLE), 6) AS mean, round(CASE WHEN count(c_acctbal) > 1 THEN stddev_samp(c_acctbal::DOUBLE) WHEN count(c_acctbal) = 1 THEN 0 END, 6) AS sd, round(max(c_acctbal::DOUBLE) - min(c_acctbal::DOUBLE), 6) AS range FROM customer GROUP BY 1")
def balance_spread(spark, d):
    found = table(spark, d, "customer").withColumn("b", F.col("c_acctbal").cast("double")).groupBy("c_nationkey").agg(*S.spread("b"))
    return found.select("c_nationkey", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "range")))


@query("""WITH r AS (SELECT l_returnflag, l_quantity::DOUBLE AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_quantity IS NOT NULL)
SELECT l_returnflag, max(v) FILTER (i = floor((n - 1) * 0.9)) AS floor_p90, max(v) FILTER (i = greatest(ceil(n * 0.1) - 1, 0)) AS ceil_p10 FROM r GROUP BY 1""")
def index_quantiles(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("v"))
    a, b = S.index_quantile(rows, ["l_returnflag"], "v", 0.9), S.index_quantile(rows, ["l_returnflag"], "v", 0.1, ceil=True)
    return a.withColumnRenamed("quantile", "floor_p90").join(b.select(F.col("l_returnflag").alias("k"), F.col("quantile").alias("ceil_p10")), F.col("l_returnflag").eqNullSafe(F.col("k"))).drop("k")


@query(f"""WITH {_RATED_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND long = 1) AS tp, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1 AND long <> 1) AS tn, count(*) FILTER (quality <> 1) AS ne, count(*) FILTER (long = 1) AS pp FROM rated)
SELECT n, tp::DOUBLE / nullif(pp, 0) AS precision, tp::DOUBLE / nullif(p, 0) AS recall, tn::DOUBLE / nullif(ne, 0) AS specificity, (tp::DOUBLE / nullif(p, 0) + tn::DOUBLE / nullif(ne, 0)) / 2 AS balanced_accuracy FROM c""")
def rule_quality(spark, d):
    return rated(spark, d).agg(*(c.alias(n) for n, c in S.rule_quality(F.col("quality") == 1, F.col("long") == 1).items()))


@query("""SELECT source, lang, count(*) AS n, avg(quality) AS accuracy, avg(n_chars) AS mean_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""")
def calibration_by_source(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("accuracy"), F.avg("n_chars").alias("mean_chars"))


@query("""WITH a AS (SELECT l_orderkey, max(l_extendedprice) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_orderkey, max(l_extendedprice) AS w FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT count(*) AS groups, count(*) FILTER (v > w) AS left_wins, count(*) FILTER (v < w) AS right_wins, count(*) FILTER (v = w) AS ties FROM a JOIN b USING (l_orderkey) WHERE v IS NOT NULL AND w IS NOT NULL""")
def best_of_orders(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_extendedprice")
    return S.best_of_group(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'"), ["l_orderkey"], "l_extendedprice")


@query("""WITH r AS (SELECT c_mktsegment AS arm, c_nationkey AS seed, avg(c_acctbal::DOUBLE) AS v FROM customer GROUP BY 1, 2), f AS (SELECT arm, greatest(4.0 * 500, 0.5 * median(v)) AS floor FROM r GROUP BY 1)
SELECT r.arm AS arm, seed, round(floor, 6) AS floor, v >= floor AS converged FROM r JOIN f ON r.arm = f.arm""")
def converged_runs(spark, d):
    runs = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("arm"), F.col("c_nationkey").alias("seed")).agg(F.avg(F.col("c_acctbal").cast("double")).alias("v"))
    return S.convergence(runs, "arm", "v", 500).select("arm", "seed", F.round("floor", 6).alias("floor"), "converged")


@query("""SELECT s_suppkey, CASE WHEN s_acctbal IS NULL OR s_nationkey IS NULL THEN 'incomplete' WHEN (s_nationkey - 20) / 100.0 < -0.02 THEN 'rejected' WHEN s_acctbal::DOUBLE / 100000 >= 0.01 THEN 'eligible' ELSE 'non_inferior_only' END AS decision FROM supplier""")
def arm_decisions(spark, d):
    rows = table(spark, d, "supplier")
    return rows.select("s_suppkey", S.decision(F.col("s_acctbal").cast("double") / 100000, 0.01, {"other": ((F.col("s_nationkey") - 20) / 100.0, 0.02)}).alias("decision"))


@query("""SELECT o_orderkey, coalesce(o_totalprice >= 50000, false) AS price, coalesce(o_custkey <= 700, false) AS customer, coalesce(o_totalprice >= 50000, false) AND coalesce(o_custkey <= 700, false) AS passed FROM orders""")
def order_gates(spark, d):
    g = S.gates({"price": (F.col("o_totalprice"), "higher", 50000), "customer": (F.col("o_custkey"), "lower", 700)})
    return table(spark, d, "orders").select("o_orderkey", *(c.alias(n) for n, c in g.items()))


@query("""WITH a AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_nationkey + (c_custkey % 3 = 0)::INT AS c_nationkey FROM customer),
j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_custkey IS NULL OR b.c_custkey IS NULL AS one, a.c_mktsegment IS DISTINCT FROM b.c_mktsegment AS s, a.c_nationkey IS DISTINCT FROM b.c_nationkey AS n FROM a FULL JOIN b ON a.c_custkey = b.c_custkey)
SELECT c_custkey, CASE WHEN one THEN 'c_custkey' ELSE concat_ws(',', CASE WHEN s THEN 'c_mktsegment' END, CASE WHEN n THEN 'c_nationkey' END) END AS differs FROM j WHERE one OR s OR n""")
def contract_drift(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    other = c.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("c_nationkey") + (F.col("c_custkey") % 3 == 0).cast("int")).alias("c_nationkey"))
    found = S.contract_differences(c.where("c_custkey % 7 <> 0"), other, "c_custkey", ["c_nationkey", "c_mktsegment"])
    return found.select("c_custkey", F.array_join("differs", ",").alias("differs"))


@query("""WITH m AS (SELECT unnest(['A', 'N', 'X']) AS metric), a AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL), f AS (SELECT l_suppkey, l_returnflag AS metric, count(DISTINCT l_linenumber) AS n_seeds, avg(l_quantity::DOUBLE) AS mean FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1, 2)
SELECT a.l_suppkey AS l_suppkey, m.metric AS metric, coalesce(n_seeds, 0) AS n_seeds, round(mean, 9) AS mean, coalesce(n_seeds, 0) >= 7 AS complete FROM a CROSS JOIN m LEFT JOIN f ON f.l_suppkey = a.l_suppkey AND f.metric = m.metric""")
def arm_evidence(spark, d):
    rows = table(spark, d, "lineitem").where("l_suppkey is not null").select("l_suppkey", F.col("l_returnflag").alias("metric"), "l_linenumber", F.col("l_quantity").cast("double").alias("v"))
    return S.evidence(rows, "l_suppkey", "l_linenumber", "metric", "v", ["A", "N", "X"], 7).withColumn("mean", F.round("mean", 9))


@query(f"""WITH {_RATED_SQL}, o AS (SELECT count(*) AS items, avg((quality = calm)::INT) AS observed, avg(quality) * avg(calm) + (1 - avg(quality)) * (1 - avg(calm)) AS e FROM rated) SELECT 2::BIGINT AS raters, items, observed, round((observed - e) / (1 - e), 9) AS kappa FROM o""")
def imported_ratings(spark, d):
    """Two raters' answers in long form."""
    rows = rated(spark, d).select("doc_id", F.explode(F.array(F.struct(F.lit("a").alias("rater"), F.col("quality").alias("label")), F.struct(F.lit("b").alias("rater"), F.col("calm").alias("label")))).alias("x")).select("doc_id", "x.*")
    return S.kappa_by_raters(rows, "doc_id", "rater", "label").withColumn("kappa", F.round("kappa", 9))


_ARMS = """WITH a AS (SELECT l_suppkey AS id, avg(l_discount::DOUBLE) AS discount, avg(l_tax::DOUBLE) AS tax FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_suppkey AS id, avg(l_discount::DOUBLE) AS discount, avg(l_tax::DOUBLE) AS tax FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), """


@query("SELECT *, CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'open' END AS verdict FROM (" + _ARMS + poisson_sql("SELECT 'discount' AS metric, id, b.discount - a.discount AS d FROM a JOIN b USING (id) UNION ALL SELECT 'tax', id, b.tax - a.tax FROM a JOIN b USING (id)", 100) + ")")
def arm_comparison(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_linestatus", *(F.col(f"l_{c}").cast("double").alias(c) for c in ("discount", "tax")))
    found = S.compare_arms(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'"), "l_suppkey", ["discount", "tax"], 100)
    return rounded_interval(found).join(found.select("metric", "verdict"), "metric")


@query()
def seed_bootstrap(spark, d):
    """Means of twelve seeds, by numpy's stream; against numpy itself in the tests."""
    return S.paired_bootstrap(_runs(spark, d), "metric", "l", "r", "seed", 2000, 20260721, "pcg64", (0.95, 0.975))


@query("""SELECT lang, source, count(*) AS n, avg(n_chars) AS mean_chars, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.95) AS p95, avg((text LIKE '%?%')::INT) AS questions FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())""")
def data_audit(spark, d):
    """Counts and lengths by language and source, by language, and of all."""
    rows = table(spark, d, "documents")
    return rows.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"), F.percentile("n_chars", 0.5).alias("p50"), F.percentile("n_chars", 0.95).alias("p95"), F.avg(F.col("text").contains("?").cast("int")).alias("questions"))
