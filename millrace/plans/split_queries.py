"""Queries of splits, overlap between sets, and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import splits as P
from ..operators.tables import written
from .catalog import _FORM, _PLACE, _words, conversation_records, dedup, normal_form_groups, query, table

#: Orders as records, their parts as positives, the parts of the next order key as negatives.
_SHOP_SQL = """o AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_suppkey * 1000 + l_linenumber))) AS parts FROM lineitem WHERE l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1),
recs AS (SELECT o.k AS k, o.parts AS positives, coalesce(n.parts, []) AS negatives FROM o LEFT JOIN o n ON n.k = o.k + 1)"""


def shop_records(spark, d):
    lines = table(spark, d, "lineitem").where("l_orderkey is not null and l_suppkey is not null and l_linenumber is not null")
    o = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") * 1000 + F.col("l_linenumber"))).alias("parts"))
    docs = lambda c: F.transform(c, lambda x: F.struct(x.cast("string").alias("doc_id"), x.cast("string").alias("text")))
    both = o.join(o.select((F.col("k") - 1).alias("k"), F.col("parts").alias("next")), "k", "left")
    return both.select(F.col("k").alias("example_id"), docs(F.col("parts")).alias("positives"), docs(F.coalesce("next", F.slice("parts", 1, 0))).alias("hard_negatives"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'q:' || conv_id AS a, 'd:' || md5(text) AS b FROM conversations WHERE role = 'assistant'), und AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT DISTINCT a, a FROM und UNION SELECT und.b, r.root FROM r JOIN und ON und.a = r.node) SELECT substr(node, 3)::BIGINT AS example_id, min(root) AS component FROM r WHERE starts_with(node, 'q:') GROUP BY node""")
def record_components(spark, d):
    """Conversations that share an answer, directly or over others."""
    rows = table(spark, d, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("example_id")).agg(F.collect_set(F.struct(F.md5("text").alias("doc_id"))).alias("positives"))
    return P.record_components(rows)


@query(f"""WITH {_SHOP_SQL}, s AS (SELECT k, CASE WHEN {_PLACE.format(c='k')} < 0.8 THEN 'train' WHEN {_PLACE.format(c='k')} < 0.9 THEN 'dev' ELSE 'test' END AS split, positives, negatives FROM recs), h AS (SELECT p, list(DISTINCT split) AS homes FROM (SELECT split, unnest(positives) AS p FROM s) GROUP BY p),
e AS (SELECT k, split, unnest(negatives) AS n FROM s), x AS (SELECT k, count(*) FILTER (homes IS NOT NULL AND len(list_filter(homes, lambda z: z <> split)) > 0) AS removed, count(*) AS n FROM e LEFT JOIN h ON h.p = e.n GROUP BY k)
SELECT s.k AS example_id, split, coalesce(removed, 0) AS removed, (len(negatives) - coalesce(removed, 0))::BIGINT AS n_left, len(negatives) - coalesce(removed, 0) < 3 AS below FROM s LEFT JOIN x ON s.k = x.k""")
def crossing_negatives(spark, d):
    rows = written(shop_records(spark, d), "records")
    placed = rows.select("example_id", dedup.hash_split(F.col("example_id"), {"train": 0.8, "dev": 0.1, "test": 0.1}).alias("split"))
    return P.drop_crossing_negatives(rows, placed, 3).select("example_id", "split", "removed", F.size("hard_negatives").cast("long").alias("n_left"), "below")


@query(f"""WITH s AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS h, CASE WHEN {_PLACE.format(c='doc_id')} < 0.8 THEN 'train' WHEN {_PLACE.format(c='doc_id')} < 0.9 THEN 'dev' ELSE 'test' END AS split FROM documents), p AS (SELECT split, substr(h, 1, 3) AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM s GROUP BY 1, 2)
SELECT split, sum(n)::BIGINT AS n, sum(n)::DOUBLE / (SELECT count(*) FROM s) AS share, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM p GROUP BY split""")
def split_manifest(spark, d):
    rows = table(spark, d, "documents").select("doc_id", dedup.hash_split(F.col("doc_id"), {"train": 0.8, "dev": 0.1, "test": 0.1}).alias("split"))
    return P.split_manifest(rows, "doc_id", "split")


@query(f"""WITH a AS (SELECT DISTINCT {_FORM.format(c='text')} AS k FROM conversations WHERE role = 'user' AND text IS NOT NULL), b AS (SELECT DISTINCT {_FORM.format(c='text')} AS k FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
SELECT (SELECT count(*) FROM a) AS "left", (SELECT count(*) FROM b) AS "right", (SELECT count(*) FROM a JOIN b USING (k)) AS shared""")
def role_overlap(spark, d):
    rows = table(spark, d, "conversations")
    return P.exact_overlap(rows.where("role = 'user'"), rows.where("role = 'assistant'"), T.normal_form(F.col("text")))


_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))"


@query(f"""WITH a AS (SELECT item_id, len(s) AS na, unnest(s) AS s FROM (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_words('text')} AS w FROM benchmark) WHERE len(w) >= 5)),
b AS (SELECT doc_id, len(s) AS nb, unnest(s) AS s FROM (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_words('text')} AS w FROM documents) WHERE len(w) >= 5)), c AS (SELECT item_id, doc_id, na, nb, count(*) AS n FROM a JOIN b ON a.s = b.s GROUP BY ALL)
SELECT (SELECT count(DISTINCT item_id) FROM a) AS rows, count(DISTINCT item_id) AS present, count(DISTINCT item_id)::DOUBLE / (SELECT count(DISTINCT item_id) FROM a) AS share FROM c WHERE n::DOUBLE / (na + nb - n) >= 0.02""")
def benchmark_presence(spark, d):
    runs = lambda df, i: df.select(i, T.words(F.col("text")).alias("w")).where(F.size("w") >= 5).select(i, F.array_distinct(T.shingles(F.col("w"), 5)).alias("shingles"))
    return P.presence(runs(table(spark, d, "benchmark"), "item_id"), runs(table(spark, d, "documents"), "doc_id"), "item_id", "doc_id", 0.02)


_GROUPS = f"g AS (SELECT doc_id, text, min(doc_id) OVER w AS canonical FROM documents WINDOW w AS (PARTITION BY {_FORM.format(c='text')}))"


@query(f"""WITH {_GROUPS}, s AS (SELECT canonical, count(*) AS size FROM g GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY size DESC, canonical) AS rank FROM s), m AS (SELECT canonical, left(text, 300) AS t, row_number() OVER (PARTITION BY canonical ORDER BY doc_id) AS i FROM g)
SELECT rank, canonical, size, md5(string_agg(t, chr(10) ORDER BY i)) AS previews FROM t JOIN m USING (canonical) WHERE rank <= 50 AND i <= 5 GROUP BY rank, canonical, size""")
def cluster_report(spark, d):
    groups = normal_form_groups(spark, d).select("doc_id", "canonical").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return P.cluster_report(groups, "doc_id", "text").withColumn("previews", F.md5(F.array_join("previews", "\n")))


@query(f"""WITH {_GROUPS}, s AS (SELECT canonical, count(*) AS size FROM g GROUP BY 1) SELECT doc_id, canonical, size FROM g JOIN s USING (canonical) WHERE doc_id IN (SELECT doc_id FROM labels)""")
def labelled_cluster_sizes(spark, d):
    return P.cluster_sizes(normal_form_groups(spark, d).select("doc_id", "canonical"), table(spark, d, "labels"), "doc_id")


@query("""SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type""")
def first_events(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return P.first_of_key(rows, F.struct("user_id", "event_type"), "event_id")


@query(f"""WITH p AS (SELECT o_orderpriority AS q, o_orderstatus AS p FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL) SELECT sha256(q || chr(0) || p) AS pair_id, count(*) AS n, (len({_words('q')}) + len({_words('p')})) // 2 AS bucket FROM p GROUP BY q, p""")
def scoring_pairs(spark, d):
    rows = table(spark, d, "orders").where("o_orderpriority is not null and o_orderstatus is not null")
    pairs, keyed = P.scoring_pairs(rows, "o_orderpriority", "o_orderstatus", 2)
    return pairs.join(keyed.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")), "pair_id").select("pair_id", "n", "bucket")


@query()
def question_clusters(spark, d):
    """Near copies among a conversation's questions; against plain loops in the tests."""
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return P.group_clusters(rows, "conv_id", "turn", "text", 0.3).select("conv_id", "turn", "cluster")


@query()
def label_clusters(spark, d):
    """Clusters by cosine among the vectors of a small group; against plain loops in the tests."""
    rows = table(spark, d, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 8))
    return P.semantic_clusters(rows, "g", "embedding", 0.3)


@query("""SELECT 'user_id' AS key, count(*) AS shared FROM (SELECT user_id FROM events WHERE event_type = 'click' AND user_id IS NOT NULL INTERSECT SELECT user_id FROM events WHERE event_type <> 'click' AND user_id IS NOT NULL) UNION ALL SELECT 'event_id', count(*) FROM (SELECT event_id FROM events WHERE event_type = 'click' INTERSECT SELECT event_id FROM events WHERE event_type <> 'click')""")
def key_leakage(spark, d):
    rows = table(spark, d, "events")
    return P.leakage(rows.where("event_type = 'click'"), rows.where("event_type <> 'click'"), ["user_id", "event_id"])


@query()
def component_splits(spark, d):
    """Components of conversations that share an answer, whole in one split; the tests look for leaks and at the shares."""
    return P.balanced_components(conversation_records(spark, d).withColumn("positives", F.transform("positives", lambda p: F.struct(F.md5(p["text"]).alias("doc_id")))), {"train": 0.9, "dev": 0.05, "test": 0.05})
