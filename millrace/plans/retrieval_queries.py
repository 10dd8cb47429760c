"""Queries of retrieval evaluation and hard negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import statistics as S
from ..operators.tables import written
from .catalog import _BM25_SQL, _DOT, _GRADED_SQL, _POOL_SQL, _RELEVANT_SQL, bm25_hits, bm25_index, bm25_ranked, poisson_sql, pools, query, relevant, rounded_interval, table

_ROUND_TRIP = f"""{_BM25_SQL}, {_RELEVANT_SQL}, top AS (SELECT * FROM ranked WHERE rank <= 200), sides AS (SELECT t.query AS query, t.score AS score, t.rank AS rank, r.doc IS NOT NULL AS p FROM top t LEFT JOIN rel r ON t.query = r.query AND t.doc = r.doc),
m AS (SELECT query, min(rank) FILTER (p) AS r, max(score) FILTER (p) AS best_positive, max(score) FILTER (NOT p) AS best_other FROM sides GROUP BY query)"""


@query(f"""WITH {_ROUND_TRIP} SELECT q.query AS query, {', '.join(f'coalesce(r <= {k}, false) AS hit_at_{k}' for k in (1, 5, 20, 100))}, round(best_positive, 6) AS best_positive, round(best_other, 6) AS best_other, round(best_positive - best_other, 6) AS margin
FROM (SELECT DISTINCT query FROM rel) q LEFT JOIN m USING (query)""")
def bm25_round_trip(spark, d):
    found = R.round_trip(bm25_ranked(spark, d).where("rank <= 200"), relevant(spark, d), R.checked_cutoffs((1, 5, 20, 100), 200))
    return found.select("query", *(c for c in found.columns if c.startswith("hit")), *(F.round(c, 6).alias(c) for c in ("best_positive", "best_other", "margin")))


@query(f"""WITH {_BM25_SQL}, w AS (SELECT item_id AS query, doc_id AS doc FROM documents JOIN benchmark ON item_id = doc_id % (SELECT count(*) FROM benchmark)) SELECT w.query AS query, w.doc AS doc, round(coalesce(s.score, 0), 6)::DOUBLE AS score FROM w LEFT JOIN scores s ON w.query = s.query AND w.doc = s.doc""")
def bm25_given(spark, d):
    """Scores of given pairs: every document with one item."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"))
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("doc")).withColumn("query", F.col("doc") % items.count()).join(items, "query").select("query", "doc")
    return R.scores_of(bm25_hits(spark, d).given(wanted), wanted, bm25_index(spark, d).docs).select("query", "doc", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25_SQL}, {_RELEVANT_SQL}, n AS (SELECT r.query AS query, r.doc AS doc, round(score, 6) AS score, row_number() OVER (PARTITION BY r.query ORDER BY rank) AS position FROM ranked r LEFT JOIN rel ON rel.query = r.query AND rel.doc = r.doc WHERE rel.doc IS NULL) SELECT * FROM n WHERE position <= 5""")
def bm25_negatives(spark, d):
    rel = written(relevant(spark, d), "relevant")
    return R.mined_negatives(bm25_hits(spark, d).best(5, rel), rel, 5).select("query", "doc", F.round("score", 6).alias("score"), "position")


_SCORED = f"s AS (SELECT q.vec_id AS query, q.label AS own, c.vec_id AS doc, c.label AS label, {_DOT} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)"


@query(f"""WITH {_SCORED}, p AS (SELECT query, min(doc) AS doc FROM s WHERE own = label AND doc <> query GROUP BY query)
SELECT p.query AS query, p.doc AS doc, 1 + count(*) FILTER (round(o.score, 9) > round(m.score, 9) OR (round(o.score, 9) = round(m.score, 9) AND o.doc < p.doc)) AS rank FROM p JOIN s m ON m.query = p.query AND m.doc = p.doc JOIN s o ON o.query = p.query GROUP BY p.query, p.doc""")
def dense_ranks(spark, d):
    """The exact rank of the first other vector of the same label."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0")
    p = q.select(F.col("vec_id").alias("query"), "label").join(v.select(F.col("vec_id").alias("doc"), "label"), "label").where("doc <> query").groupBy("query").agg(F.min("doc").alias("doc"))
    return R.dense_ranks(v, q.select("vec_id", "embedding"), p, "vec_id", "embedding")


@query(f"""WITH {_SCORED}, r AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s WHERE label <> own AND label < 5) SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def dense_negatives(spark, d):
    """The nearest vectors of other labels among the allowed ones."""
    v = table(spark, d, "embeddings")
    top = R.dense_scores(v, v.where("vec_id % 20 = 0"), 5, "vec_id", "embedding", v.where("label < 5"), apart="label")
    return top.select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_POOL_SQL} SELECT query, avg((positive > n)::INT) AS rate FROM pools, unnest(negatives) AS u(n) WHERE positive IS NOT NULL AND n IS NOT NULL GROUP BY query""")
def win_rates(spark, d):
    rows = pools(spark, d).where("positive is not null").select("query", R.win_rate(F.array("positive"), F.array_compact("negatives")).alias("rate"))
    return rows.where("rate is not null")


@query("""WITH p AS (SELECT l_suppkey AS query, list_sort(list_distinct(list(l_partkey) FILTER (l_quantity > 45))) AS positives, list_sort(list_distinct(list(l_partkey) FILTER (l_quantity < 3))) AS negatives FROM lineitem GROUP BY 1 HAVING len(positives) > 0 AND len(negatives) > 0),
c AS (SELECT query, p_partkey AS doc, row_number() OVER (PARTITION BY query ORDER BY p_partkey) AS i, len(negatives) AS have FROM p, part WHERE NOT list_contains(positives, p_partkey) AND NOT list_contains(negatives, p_partkey))
SELECT query, md5(array_to_string(list_sort(list(doc)), ',')) AS added_docs, count(*)::INT AS added FROM c WHERE i <= 40 - have GROUP BY query""")
def filled_pools(spark, d):
    side = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_partkey"))))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query")).agg(side(F.col("l_quantity") > 45).alias("positives"), side(F.col("l_quantity") < 3).alias("negatives")).where("size(positives) > 0 and size(negatives) > 0")
    found = R.pool_backfill(rows, table(spark, d, "part").select(F.col("p_partkey").alias("doc")), 40).where("added > 0")
    added = F.array_sort(F.slice("filled", F.size("negatives") + 1, F.col("added")))
    return found.select("query", F.md5(F.array_join(F.transform(added, lambda x: x.cast("string")), ",")).alias("added_docs"), "added")


@query("""SELECT doc_id, n_chars FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)""")
def labelled_texts(spark, d):
    return R.texts_of(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "n_chars")


_JUDGES_SQL = """g AS (SELECT l_orderkey AS id, list(l_quantity::DOUBLE ORDER BY l_linenumber, l_quantity, l_extendedprice) AS a, list(l_extendedprice::DOUBLE ORDER BY l_linenumber, l_quantity, l_extendedprice) AS b FROM lineitem GROUP BY 1 HAVING count(*) > 1),
j AS (SELECT id, 1 + len(list_filter(a[2:], lambda x: x >= a[1])) AS ra, 1 + len(list_filter(b[2:], lambda x: x >= b[1])) AS rb, a[1] - list_max(a[2:]) AS ma, b[1] - list_max(b[2:]) AS mb FROM g)"""


@query(f"WITH {_JUDGES_SQL} SELECT count(*) AS shared, avg((ra = rb)::INT) AS same_rank, avg(((ra = 1) = (rb = 1))::INT) AS same_winner, round(corr(ma, mb), 9) AS margin_r, count(*) FILTER ((ra = 1) <> (rb = 1)) AS disagreed FROM j")
def judge_agreement(spark, d):
    """Quantity and price as two judges of an order's first line."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice")))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(lines.alias("l")).where("size(l) > 1")

    def judge(c):
        s = F.transform("l", lambda x: x[c].cast("double"))
        m = R.pool_metrics(F.get(s, 0), F.slice(s, 2, 1000))
        return g.select("id", m["pool_rank"].alias("rank"), m["pool_margin"].alias("margin"))

    return R.judge_agreement(judge("l_quantity"), judge("l_extendedprice"), "id").withColumn("margin_r", F.round("margin_r", 9))


@query("""WITH q AS (SELECT l_suppkey, avg(l_quantity::DOUBLE) AS m, count(l_quantity) AS n FROM lineitem GROUP BY 1) SELECT sum(n)::BIGINT AS pairs, count(*) AS queries, round(sum(m * n) / sum(n), 9) AS micro, round(avg(m), 9) AS macro FROM q WHERE n > 0""")
def micro_macro(spark, d):
    found = R.micro_and_macro(table(spark, d, "lineitem"), "l_suppkey", "l_quantity")
    return found.select("pairs", "queries", F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"))


def _candidates(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("doc"), "l_quantity", "l_linenumber")
    return lines.groupBy("query", "doc").agg(F.max(F.col("l_quantity").cast("double")).alias("score"), F.min("l_linenumber").alias("position"))


_CANDIDATES = "c AS (SELECT l_orderkey AS query, l_partkey AS doc, max(l_quantity::DOUBLE) AS score, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_CANDIDATES}, h AS (SELECT *, sha256('recipe:' || query::VARCHAR || ':' || doc::VARCHAR) AS h, coalesce(score >= 40, false) AS flagged FROM c),
r AS (SELECT 'hash' AS recipe, query, doc, row_number() OVER (PARTITION BY query ORDER BY h, doc) AS p FROM h UNION ALL SELECT 'hash_unflagged', query, doc, row_number() OVER (PARTITION BY query ORDER BY h, doc) FROM h WHERE NOT flagged UNION ALL SELECT 'miner_unflagged', query, doc, row_number() OVER (PARTITION BY query ORDER BY position, doc) FROM h WHERE NOT flagged)
SELECT recipe, query, doc, p AS chosen_position FROM r WHERE p <= 2""")
def negative_recipes(spark, d):
    parts = [R.negatives_by_recipe(_candidates(spark, d), "query", "doc", "score", "position", r, 40, 2).select(F.lit(r).alias("recipe"), "query", "doc", "chosen_position") for r in ("hash", "hash_unflagged", "miner_unflagged")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT count(*) AS n, count(l_quantity) AS scored, count(*) FILTER (l_quantity >= 40) AS flagged, count(*) FILTER (l_quantity >= 40)::DOUBLE / count(l_quantity) AS flag_rate, count(*) FILTER (l_quantity IS NULL OR l_quantity < 40) AS kept, count(*) FILTER (l_quantity >= 40) AS changed FROM lineitem")
def negative_audit(spark, d):
    return R.flag_audit(R.false_negative_actions(table(spark, d, "lineitem"), "l_quantity", 40, "demote"), "l_quantity")


@query(f"WITH {_POOL_SQL} SELECT query, count(*) FILTER (n < 60 AND n < positive) AS kept, count(*) AS n FROM pools, unnest(negatives) AS u(n) WHERE positive IS NOT NULL GROUP BY query")
def positive_aware(spark, d):
    keep = F.filter("negatives", lambda n: R.positive_aware(n, F.col("positive"), 60))
    return pools(spark, d).where("positive is not null").select("query", F.size(keep).cast("long").alias("kept"), F.size("negatives").cast("long").alias("n"))


def _graded(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query"), (F.col("l_quantity").cast("double") + 10 * (F.col("l_returnflag") == "R").cast("int")).alias("score"), (F.col("l_returnflag") == "R").alias("positive"))


@query(f"WITH {_GRADED_SQL} SELECT query, avg((score >= 35)::INT) FILTER (positive) - avg((score >= 35)::INT) FILTER (NOT positive) AS j FROM graded GROUP BY query HAVING count(*) FILTER (positive) > 0 AND count(*) FILTER (NOT positive) > 0")
def youden_by_query(spark, d):
    return R.youden_by_query(_graded(spark, d), 35)


@query("""WITH v AS (SELECT l_suppkey AS query, l_orderkey * 10 + l_linenumber AS doc, max(l_extendedprice::DOUBLE) AS score, bool_or(l_returnflag = 'R') AS positive FROM lineitem GROUP BY 1, 2),
b AS (SELECT query, arg_max(doc, (score, -doc)) AS hardest, max(score) AS top FROM v WHERE NOT positive GROUP BY query) SELECT query, doc AS positive, hardest, round(score - top, 6) AS margin FROM v JOIN b USING (query) WHERE positive""")
def train_margins(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc")).agg(F.max(F.col("l_extendedprice").cast("double")).alias("score"), F.max(F.col("l_returnflag") == "R").alias("positive"))
    return R.hardest_negative(rows, "query", "doc", "score", "positive").withColumn("margin", F.round("margin", 6))


@query(f"""WITH {_CANDIDATES}, k AS (SELECT query, arg_min(doc, (position, doc)) AS doc FROM c WHERE NOT coalesce(score >= 40, false) GROUP BY query) SELECT o_orderkey AS query, o_orderpriority AS text, doc FROM orders JOIN k ON o_orderkey = query ORDER BY sha256('probe:' || o_orderkey::VARCHAR), o_orderkey LIMIT 50""")
def probe_pairs(spark, d):
    c = _candidates(spark, d)
    actions = R.false_negative_actions(c, "score", 40, "drop").select("query", "doc", "action")
    generated = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_orderpriority").alias("text"))
    return R.probe_pairs(generated, c.select("query", "doc", F.col("position").alias("rank")), actions, 50, "probe")


@query(f"""WITH {_GRADED_SQL}, q AS (SELECT query, avg((score >= 35)::INT) FILTER (positive) - avg((score >= 35)::INT) FILTER (NOT positive) AS j FROM graded GROUP BY query HAVING count(*) FILTER (positive) > 0 AND count(*) FILTER (NOT positive) > 0), """
    + poisson_sql("SELECT 'j' AS metric, query AS id, j AS d FROM q", 100))
def calibration_interval(spark, d):
    rows = R.youden_by_query(_graded(spark, d), 35).withColumns({"metric": F.lit("j"), "zero": F.lit(0.0)})
    return rounded_interval(S.poisson_bootstrap(rows, "metric", "zero", "j", "query", 100))
