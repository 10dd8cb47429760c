"""Queries of audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import audits as A
from ..operators import retrieval as R
from .catalog import _PAIRS_SQL, _list, _words, conversation_pairs, query, table
from .retrieval_queries import _JUDGES_SQL, _candidates

_SPREAD = "count(v) AS n, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.05), 9) AS p05, round(quantile_cont(v, 0.5), 9) AS p50"


@query(f"""WITH d AS (SELECT lang, source, length(text)::DOUBLE AS chars, len({_words('text')})::DOUBLE AS words, (contains(text, '?'))::INT AS asks FROM documents)
SELECT 'length' AS section, 'chars' AS name, NULL AS value, {_SPREAD.replace('(v', '(chars')} FROM d UNION ALL SELECT 'length', 'words', NULL, {_SPREAD.replace('(v', '(words')} FROM d
UNION ALL SELECT 'category', 'lang', coalesce(lang, 'unknown'), count(*), NULL, NULL, NULL FROM d GROUP BY 3 UNION ALL SELECT 'category', 'source', coalesce(source, 'unknown'), count(*), NULL, NULL, NULL FROM d GROUP BY 3 UNION ALL SELECT 'rate', 'asks', NULL, count(asks), round(avg(asks), 9), NULL, NULL FROM d""")
def corpus_audit(spark, d):
    rows = table(spark, d, "documents")
    found = A.data_audit(rows, {"chars": F.length("text"), "words": F.size(T.words(F.col("text")))}, ["lang", "source"], {"asks": F.contains("text", F.lit("?"))})
    return found.select("section", "name", "value", "n", *(F.round(c, 9).alias(c) for c in ("mean", "p05", "p50")))


@query("SELECT doc_id, left(text, 300) AS shown FROM documents ORDER BY sha256('look:' || doc_id::VARCHAR), doc_id LIMIT 50")
def audit_examples(spark, d):
    return A.sampled_examples(table(spark, d, "documents"), "doc_id", "text", 50, "look")


@query(f"""WITH q AS (SELECT role, {_words('text')}[1] AS w FROM conversations), s AS (SELECT 'all' AS field, 'all' AS value, w FROM q UNION ALL SELECT 'role', coalesce(role, 'unknown'), w FROM q), c AS (SELECT field, value, w, count(*) AS n FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY field, value ORDER BY n DESC, encode(w)) AS i, sum(n) OVER (PARTITION BY field, value) AS t FROM c WHERE w IS NOT NULL), g AS (SELECT field, value, count(*) AS distinct_, sum(n) FILTER (i <= 1) / any_value(t) AS top_1, sum(n) FILTER (i <= 3) / any_value(t) AS top_3, sum(n) FILTER (i <= 5) / any_value(t) AS top_5, ln(any_value(t)) - sum(n * ln(n)) / any_value(t) AS h FROM r GROUP BY 1, 2),
a AS (SELECT field, value, sum(n)::BIGINT AS queries, coalesce(sum(n) FILTER (w IS NULL), 0)::BIGINT AS without_words FROM c GROUP BY 1, 2)
SELECT a.field AS field, a.value AS value, queries, without_words, coalesce(distinct_, 0) AS "distinct", round(top_1, 9) AS top_1, round(top_3, 9) AS top_3, round(top_5, 9) AS top_5, round(h, 9) AS entropy_nats, round(CASE WHEN distinct_ > 1 THEN h / ln(distinct_) WHEN distinct_ = 1 THEN 0 END, 9) AS normalized_entropy FROM a LEFT JOIN g ON a.field = g.field AND a.value = g.value""")
def opening_monotony(spark, d):
    found = A.monotony(table(spark, d, "conversations"), "text", ["role"])
    return found.select("field", "value", "queries", "without_words", "distinct", *(F.round(c, 9).alias(c) for c in ("top_1", "top_3", "top_5", "entropy_nats", "normalized_entropy")))


_GUESS = "CASE WHEN n_chars < 300 THEN 'unknown' WHEN n_chars % 2 = 0 THEN '1' ELSE '0' END"


@query(f"""WITH r AS (SELECT source, quality::VARCHAR AS g, {_GUESS} AS p, (n_chars % 100) / 100.0::DOUBLE AS c FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL)
SELECT source, count(*) AS n, count(*) FILTER (coalesce(p, 'unknown') <> 'unknown') AS covered, round(count(*) FILTER (coalesce(p, 'unknown') <> 'unknown') / count(*), 9) AS coverage, round(avg((g = p)::INT) FILTER (p <> 'unknown'), 9) AS accuracy, round(avg(c) FILTER (p <> 'unknown'), 9) AS mean_confidence, round(abs(avg(c) FILTER (p <> 'unknown') - avg((g = p)::INT) FILTER (p <> 'unknown')), 9) AS gap FROM r GROUP BY source""")
def covered_accuracy(spark, d):
    guess = F.when(F.col("n_chars") < 300, "unknown").when(F.col("n_chars") % 2 == 0, "1").otherwise("0")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", F.col("quality").cast("string").alias("g"), guess.alias("p"), (F.col("n_chars") % 100 / 100).alias("c"))
    found = A.covered_accuracy(rows, "g", "p", ["source"], "c")
    return found.select("source", "n", "covered", *(F.round(c, 9).alias(c) for c in ("coverage", "accuracy", "mean_confidence", "gap")))


@query("""WITH r AS (SELECT coalesce(l_returnflag, 'unknown') AS l_returnflag, coalesce(l_linestatus, 'unknown') AS l_linestatus, l_quantity::DOUBLE AS q, l_tax::DOUBLE AS t FROM lineitem) SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(q), 9) AS q, round(avg(t), 9) AS t FROM r GROUP BY CUBE (l_returnflag, l_linestatus)""")
def line_difficulty(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    return A.difficulty_report(rows, ["l_returnflag", "l_linestatus"], ["q", "t"]).withColumns({c: F.round(c, 9) for c in ("q", "t")})


@query("""WITH s AS (SELECT l_partkey, l_quantity::VARCHAR AS v, l_orderkey * 10 + l_linenumber AS o FROM lineitem), g AS (SELECT l_partkey, count(*) AS occurrences, count(DISTINCT coalesce(v, chr(0))) AS n_values FROM s GROUP BY 1) SELECT l_partkey, occurrences, n_values, CASE WHEN n_values > 1 THEN 'conflict' WHEN occurrences > 1 THEN 'repeated' ELSE 'unique' END AS state FROM g""")
def part_occurrences(spark, d):
    rows = table(spark, d, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.occurrences(rows, "l_partkey", F.col("l_quantity"), "o").drop("kept")


@query(f"WITH {_JUDGES_SQL} SELECT id, ra::INT AS rank_a, rb::INT AS rank_b, (ra = 1) <> (rb = 1) AS winner FROM j WHERE ra <> rb")
def judge_disagreements(spark, d):
    """Orders in whose first line quantity and price rank differently."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice")))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(lines.alias("l")).where("size(l) > 1")

    def judge(c):
        s = F.transform("l", lambda x: x[c].cast("double"))
        return g.select("id", R.pool_metrics(F.get(s, 0), F.slice(s, 2, 1000))["pool_rank"].alias("rank"))

    return A.disagreements(judge("l_quantity"), judge("l_extendedprice"), "id").withColumns({c: F.col(c).cast("int") for c in ("rank_a", "rank_b")})


@query("""WITH c AS (SELECT l_orderkey, l_partkey, max(l_quantity::DOUBLE) AS score FROM lineitem GROUP BY 1, 2), a AS (SELECT score, coalesce(score >= 40, false) AS flagged FROM c), h AS (SELECT CASE WHEN flagged THEN 'demote' ELSE 'keep' END AS action, count(*) AS n, count(score) AS scored, count(*) FILTER (flagged) AS flagged FROM a GROUP BY 1) SELECT action, n, scored, flagged, round(n / sum(n) OVER (), 9) AS share, round(flagged / nullif(scored, 0), 9) AS flagged_rate FROM h""")
def action_histogram(spark, d):
    found = A.action_histogram(R.false_negative_actions(_candidates(spark, d), "score", 40.0, "demote"), "score")
    return found.withColumns({c: F.round(c, 9) for c in ("share", "flagged_rate")})


@query(rf"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{L.PLAIN_TOKEN.replace("'", "''")}') AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: list_contains({_list(L.ENGLISH)}, x)))), ',') AS english_words FROM t""")
def translation_evidence(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(L.translation_evidence(F.col("text"))["english_words"], ",").alias("english_words"))


@query(f"""WITH {_PAIRS_SQL}, k AS (SELECT conv_id, turn, (conv_id * 3 + turn) % 6 AS kind, len({_words('query')}) AS n FROM pairs WHERE query IS NOT NULL) SELECT conv_id, turn, n > 0 AND kind IN (0, 1) AS json_valid, n > 0 AND kind IN (0, 1) AS format_valid FROM k""")
def json_formats(spark, d):
    """First words of questions as a list of strings, as queries, and as four things that aren't."""
    t = conversation_pairs(spark, d).where("query is not null").select("conv_id", "turn", ((F.col("conv_id") * 3 + F.col("turn")) % 6).alias("kind"), F.slice(T.words(F.col("query")), 1, 3).alias("w"))
    some = F.size("w") > 0
    shapes = [
        F.when(some, F.to_json("w")).otherwise(F.lit("[\"\"]")), F.concat(F.lit('{"queries":'), F.to_json(F.transform("w", lambda x: F.struct(x.alias("text")))), F.lit("}")), F.concat(F.lit("```json\n"), F.to_json("w"), F.lit("\n```")), F.concat(F.to_json("w"), F.lit(",")), F.lit('["a", " "]'), F.array_join("w", "\n"),
    ]
    m = L.json_format(F.element_at(F.array(*shapes), (F.col("kind") + 1).cast("int")))
    return t.select("conv_id", "turn", m["json_valid"].alias("json_valid"), m["format_valid"].alias("format_valid"))
