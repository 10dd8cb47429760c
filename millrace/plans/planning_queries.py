"""Queries of choices that depend on the ones before: covering samples, balanced splits and batches, lanes, query sets and their audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assignment as A
from ..operators import coverage as C
from ..operators import generation as G
from ..operators.tables import ranked
from .catalog import query, table


@query()
def covered_documents(spark, d):
    """Documents that cover language, source and length, the rare sources as one; against a plain greedy loop in the tests."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", F.length(F.bin("n_chars")).alias("size_class"))
    return C.covered_sample(rows, "doc_id", ["lang", "source", "size_class"], 60, 42, pool="source", least=20)


@query()
def domain_splits(spark, d):
    """Customers as components, the priorities of their orders as domains; against the sequential rule in the tests."""
    return A.balanced_splits(table(spark, d, "orders").where("o_custkey is not null"), "o_custkey", "o_orderpriority", {"train": 0.9, "dev": 0.05, "test": 0.05})


#: Workers and what a customer's batch costs at each.
WORKERS = ("large", "medium", "small")


@query("""WITH RECURSIVE b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i, [(10 + c_custkey % 7)::BIGINT, (15 + c_custkey % 5)::BIGINT, (30 + coalesce(c_nationkey, 0) % 3)::BIGINT] AS costs FROM customer WHERE c_custkey IS NOT NULL),
s AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS c_custkey, 0::BIGINT AS w, 0::BIGINT AS cost, [0, 0, 0]::BIGINT[] AS loads, [0, 0, 0]::BIGINT[] AS n
UNION ALL SELECT t.i, t.c_custkey, t.w, t.costs[t.w], list_transform(t.loads, lambda x, k: CASE WHEN k = t.w THEN x + t.costs[t.w] ELSE x END), list_transform(t.n, lambda x, k: CASE WHEN k = t.w THEN x + 1 ELSE x END)
FROM (SELECT b.i AS i, b.c_custkey AS c_custkey, costs, loads, n, (list_sort(list_transform([1, 2, 3], lambda k: [loads[k] + costs[k], n[k], k]))[1])[3] AS w FROM s JOIN b ON b.i = s.i + 1) t)
SELECT c_custkey, ['large', 'medium', 'small'][w] AS worker, cost FROM s WHERE i > 0""")
def balanced_batches(spark, d):
    """Each customer is a batch; the worker with the least load takes it."""
    key, nation = F.col("c_custkey"), F.coalesce("c_nationkey", F.lit(0))
    costs = dict(zip(WORKERS, (10 + key % 7, 15 + key % 5, 30 + nation % 3)))
    return A.balanced_batches(table(spark, d, "customer").where("c_custkey is not null").select("c_custkey", "c_nationkey"), "c_custkey", costs).select("c_custkey", "worker", "cost")


@query("""WITH r AS (SELECT doc_id, dense_rank() OVER (ORDER BY sha256(coalesce(text, chr(0)))) - 1 AS passage_rank FROM documents) SELECT doc_id, passage_rank, (passage_rank % 4)::INT AS lane FROM r""")
def judge_lanes(spark, d):
    return A.lanes(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id", 4).select("doc_id", "passage_rank", "lane")


@query()
def request_choices(spark, d):
    """Eight requests for each document, by form, intent, focus, temperature and seed; against a plain loop in the tests."""
    sentences = F.size(T.sentences(F.coalesce("text", F.lit(""))))
    may = F.when(F.coalesce(F.col("n_chars"), F.lit(0)) >= 1000, F.array(*map(F.lit, ("fact", "definition", "procedure")))).otherwise(F.array(*map(F.lit, ("fact", "definition"))))
    docs = table(spark, d, "documents").select("doc_id", may.alias("may"), sentences.alias("sentences"))
    return C.request_choices(docs, "doc_id", "may", "sentences", ("question", "keywords", "sentence"), ("none", "bucket", "sentence"), (0.2, 0.7, 1.0), (11, 12), 8, 7)


#: A conversation's user turns as attempts, two for a slot; the last word and what stands after "?" are left out so that some repeat.
_TRIES_SQL = r"""turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, text FROM conversations WHERE role = 'user'),
tries AS (SELECT conv_id, k, k // 2 AS slot, k % 2 + 1 AS attempt, CASE WHEN length(text) % 5 > 0 THEN left(text, 12) END AS text, lower(left(text, 3)) AS key FROM turns WHERE k < 6)"""


def tries(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return turns.where("k < 6").select("conv_id", F.floor(F.col("k") / 2).alias("slot"), (F.col("k") % 2 + 1).alias("attempt"), F.when(F.length("text") % 5 > 0, F.left("text", F.lit(12))).alias("text"), F.lower(F.left("text", F.lit(3))).alias("key"))


def _sets_sql(preserve: bool) -> str:
    takes = "text IS NOT NULL" + ("" if preserve else " AND NOT again")
    return f"""WITH RECURSIVE {_TRIES_SQL}, s AS (SELECT conv_id, -1::BIGINT AS k, -1::BIGINT AS done, []::VARCHAR[] AS seen, 0::BIGINT AS attempts, 0::BIGINT AS duplicates, 0::BIGINT AS invalid, ''::VARCHAR AS accepted, 0::BIGINT AS n FROM tries WHERE k = 0
UNION ALL SELECT conv_id, k, CASE WHEN tried AND {takes} THEN slot ELSE done END, CASE WHEN tried AND {takes} THEN list_append(seen, key) ELSE seen END, attempts + tried::INT, duplicates + (tried AND again)::INT, invalid + (tried AND text IS NULL)::INT,
    CASE WHEN tried AND {takes} THEN accepted || slot || '/' || attempt || '/' || (500 + slot * 2 + attempt - 1) || '/' || again || ';' ELSE accepted END, n + (tried AND {takes})::INT
FROM (SELECT s.conv_id AS conv_id, t.k AS k, done, seen, attempts, duplicates, invalid, accepted, n, slot, attempt, text, key, slot <> done AS tried, text IS NOT NULL AND list_contains(seen, key) AS again FROM s JOIN tries t ON t.conv_id = s.conv_id AND t.k = s.k + 1))
SELECT conv_id, accepted, attempts, duplicates, invalid, n < 3 AS exhausted FROM s QUALIFY k = max(k) OVER (PARTITION BY conv_id)"""


def _shown(found):
    each = F.transform("accepted", lambda x: F.concat_ws("/", x["slot"].cast("string"), x["attempt"].cast("string"), x["seed"].cast("string"), x["duplicate"].cast("string")))
    return found.withColumn("accepted", F.concat(F.array_join(each, ";"), F.when(F.size("accepted") > 0, ";").otherwise("")))


@query(_sets_sql(False))
def query_sets(spark, d):
    return _shown(G.query_sets(tries(spark, d), "conv_id", 3, 2, 500))


@query(_sets_sql(True))
def kept_duplicates(spark, d):
    """As query_sets, where duplicates keep their slots."""
    return _shown(G.query_sets(tries(spark, d), "conv_id", 3, 2, 500, preserve=True))


#: Orders as an arm's groups and their lines as accepted rows, with faults at some of them.
_ARM_SQL = """o AS (SELECT o_orderkey AS g, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderstatus AS status FROM orders WHERE o_orderkey IS NOT NULL),
n AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS p, coalesce(l_partkey, 0) AS part, coalesce(l_suppkey, 0) AS supp FROM lineitem WHERE l_orderkey IS NOT NULL),
r AS (SELECT n.g AS g, p, CASE WHEN supp % 41 = 0 THEN NULL ELSE n.g || '::candidate::' || (p + (part % 37 = 0)::INT) END AS eid, CASE WHEN part % 31 = 0 THEN 0 ELSE p END AS slot, 'c' || (CASE WHEN part % 29 = 0 THEN 0 ELSE p END) AS control, 1 + (CASE WHEN supp % 23 = 0 THEN 3 ELSE part % 3 END) AS attempt,
    CASE WHEN part % 43 = 0 THEN '' ELSE 'k' || (part % 50) END AS key, part % 19 = 0 AS dup, CASE WHEN supp % 47 = 0 THEN 'x' ELSE status END AS status, coalesce(place, -1) * 1000 + 7 + (CASE WHEN part % 31 = 0 THEN 0 ELSE p END) * 3 + (CASE WHEN supp % 23 = 0 THEN 3 ELSE part % 3 END) + (part % 53 = 0)::INT AS seed FROM n LEFT JOIN o ON o.g = n.g)"""


def arm(spark, d):
    """(cohort, accepted, groups, summary, controls) of that arm."""
    orders = ranked(table(spark, d, "orders").where("o_orderkey is not null").select(F.col("o_orderkey").alias("group"), F.col("o_orderstatus").alias("status")), "group").withColumnRenamed("rank", "place")
    part, supp = F.coalesce("l_partkey", F.lit(0)), F.coalesce("l_suppkey", F.lit(0))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, d, "lineitem").where("l_orderkey is not null").select(F.col("l_orderkey").alias("group"), (F.row_number().over(order) - 1).alias("position"), part.alias("part"), supp.alias("supp"))
    one = lambda c, n: (F.col(c) % n == 0).cast("int")
    slot = F.when(F.col("part") % 31 == 0, 0).otherwise(F.col("position"))
    attempt = F.when(F.col("supp") % 23 == 0, 3).otherwise(F.col("part") % 3)
    rows = lines.join(orders, "group", "left").select(
        "group", "position", F.when(F.col("supp") % 41 != 0, F.concat(F.col("group").cast("string"), F.lit("::candidate::"), (F.col("position") + one("part", 37)).cast("string"))).alias("evaluation_id"),
        slot.alias("slot"), F.concat(F.lit("c"), F.when(F.col("part") % 29 == 0, 0).otherwise(F.col("position")).cast("string")).alias("control"), (1 + attempt).alias("attempt"),
        (F.coalesce("place", F.lit(-1)) * 1000 + 7 + slot * 3 + attempt + one("part", 53)).alias("seed"), F.when(F.col("part") % 43 == 0, "").otherwise(F.concat(F.lit("k"), (F.col("part") % 50).cast("string"))).alias("key"),
        (F.col("part") % 19 == 0).alias("duplicate"), F.when(F.col("supp") % 47 == 0, "x").otherwise(F.col("status")).alias("status"),
    )
    journal = orders.where("group % 61 <> 0").select("group", (F.col("place") + (F.col("group") % 59 == 0).cast("int")).alias("place"), F.lit(4).alias("attempts"), F.lit(1).alias("duplicates"), F.lit(0).alias("invalid"), (F.col("group") % 3 == 0).alias("exhausted"))
    summary = rows.agg(F.count(F.lit(1)).alias("accepted")).select("accepted", *(F.lit(0).alias(c) for c in ("attempts", "duplicates", "invalid", "exhausted")))
    controls = spark.range(7).select(F.col("id").alias("slot"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("control"))
    return orders, rows, journal, summary, controls


_FAULTS = {
    "unknown_group": "o.g IS NULL", "evaluation_id": "eid IS DISTINCT FROM r.g || '::candidate::' || p", "repeated_evaluation_id": "eid IS NOT NULL AND count(eid) OVER (PARTITION BY eid) > 1", "empty_output": "key = ''",
    "repeated_output": "key <> '' AND row_number() OVER (PARTITION BY r.g, key ORDER BY p) > 1", "duplicate_flag": "dup <> (row_number() OVER (PARTITION BY r.g, key ORDER BY p) > 1)",
    "slot_order": "NOT (slot >= coalesce(lag(slot) OVER (PARTITION BY r.g ORDER BY p) + 1, 0) AND slot < 7)", "control": "slot >= 7 OR control <> 'c' || slot", "attempt": "attempt NOT BETWEEN 1 AND 3",
    "seed": "o.g IS NOT NULL AND seed <> 7 + place * 1000 + slot * 3 + attempt - 1", "other_status": "o.g IS NOT NULL AND r.status IS DISTINCT FROM o.status",
}


@query(f"""WITH {_ARM_SQL}, f AS (SELECT r.g AS "group", p AS position, unnest(list_filter([{", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _FAULTS.items())}], lambda x: x IS NOT NULL)) AS fault FROM r LEFT JOIN o ON o.g = r.g),
j AS (SELECT * FROM o WHERE g % 61 <> 0)
SELECT * FROM f UNION ALL SELECT g, NULL, 'missing_group' FROM o WHERE g % 61 = 0 UNION ALL SELECT g, NULL, 'group_order' FROM j WHERE g % 59 = 0
UNION ALL SELECT NULL, NULL, x FROM (SELECT unnest(list_filter([CASE WHEN 4 * count(*) <> 0 THEN 'summary_attempts' END, CASE WHEN count(*) <> 0 THEN 'summary_duplicates' END, CASE WHEN count(*) FILTER (g % 3 = 0) <> 0 THEN 'summary_exhausted' END], lambda x: x IS NOT NULL)) AS x FROM j)""")
def arm_faults(spark, d):
    return G.arm_faults(*arm(spark, d), most=3, seed=7, same=["status"])


@query(f"""WITH {_ARM_SQL}, j AS (SELECT g, g % 3 = 0 AS exhausted FROM o WHERE g % 61 <> 0), c AS (SELECT g, count(*) AS n FROM r GROUP BY g), e AS (SELECT exhausted, coalesce(n, 0) AS n FROM j LEFT JOIN c USING (g))
SELECT count(*) AS groups, count(*) FILTER (n = 4 AND NOT exhausted) AS complete, count(*) FILTER (NOT (n = 4 AND NOT exhausted)) AS incomplete, sum(n)::BIGINT AS accepted, (4 * count(*))::BIGINT AS attempts, count(*) AS duplicates, 0::BIGINT AS invalid, count(*) FILTER (exhausted) AS exhausted FROM e""")
def arm_report(spark, d):
    _, accepted, groups, _, _ = arm(spark, d)
    return G.arm_report(accepted, groups, 4)


#: Eight vectors with their documents as a group, half of them anchors.
_EIGHT_SQL = r"""e AS (SELECT vec_id AS id, vec_id // 8 AS g, embedding::DOUBLE[] AS v, label FROM embeddings), full_ AS (SELECT g FROM e GROUP BY g HAVING count(*) = 8 AND count(DISTINCT id % 8) = 8),
c AS (SELECT e.g AS g, id, id % 2 = 0 AS anchor, (id % 5 = 0)::INT::DOUBLE AS risk, (id % 7) / 10.0::DOUBLE AS density, exp(-abs((id % 11) - 5.0::DOUBLE) / 2.0::DOUBLE) AS near, 1 - ln(1 + (id % 13)::DOUBLE) / ln(1 + 1000.0::DOUBLE) AS specific,
    list_distinct(['a' || id % 3, 'b' || id % 4, 'c' || label]) AS terms, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u, (id % 9)::DOUBLE AS m1, coalesce(label, 0)::DOUBLE AS m2, (row_number() OVER (PARTITION BY e.g ORDER BY id) - 1)::INT AS i FROM e JOIN full_ ON e.g = full_.g)"""


def eights(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 8).alias("g"), F.col("embedding").cast("array<double>").alias("v"), "label")
    whole = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("id") % 8).alias("k")).where("n = 8 and k = 8").select("g")
    norm = F.sqrt(F.aggregate(F.transform("v", lambda y: y * y), F.lit(0.0), lambda s, x: s + x))
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    terms = F.filter(F.array(text("a", F.col("id") % 3), text("b", F.col("id") % 4), text("c", F.col("label"))), lambda x: x.isNotNull())
    return rows.join(whole, "g").select(
        "g", "id", (F.col("id") % 2 == 0).alias("anchor"), (F.col("id") % 5 == 0).alias("copy_risk"), (F.col("id") % 7 / 10).alias("copy_density"), (F.col("id") % 11 - 5.0).alias("margin_excess"), (F.col("id") % 13).alias("n_effective"),
        F.lit(1000).alias("n_corpus"), terms.alias("terms"), F.transform("v", lambda x: x / norm).alias("vector"), (F.col("id") % 9).alias("m1"), F.coalesce("label", F.lit(0)).alias("m2"),
    )


_MEAN4 = "list_sum(list_transform(items, lambda k: cs[k + 1].{f})) / 4"


@query(f"""WITH {_EIGHT_SQL}, gs AS (SELECT g, list({{'id': id, 'anchor': anchor, 'risk': risk, 'density': density, 'near': near, 'specific': specific, 'terms': list_filter(terms, lambda t: t IS NOT NULL), 'u': u, 'm1': m1, 'm2': m2}} ORDER BY id) AS cs FROM c GROUP BY g),
s AS (SELECT list_filter(range(8), lambda k: (m >> k) & 1 = 1) AS items FROM range(256) AS r(m) WHERE bit_count(m::BIGINT) = 4),
x AS (SELECT g, items, cs, list_filter(range(8), lambda k: cs[k + 1].anchor) AS places, flatten(list_transform(items, lambda a: list_transform(list_filter(items, lambda b: b > a), lambda b: [a, b]))) AS ps FROM gs, s),
y AS (SELECT g, items, cs, places, list_sum(list_transform(items, lambda k: cs[k + 1].risk)) AS risk, list_sum(list_transform(places, lambda k: cs[k + 1].risk)) AS arisk, {_MEAN4.format(f='m1')} AS m1, {_MEAN4.format(f='m2')} AS m2, list_sum(list_transform(places, lambda k: cs[k + 1].m1)) / 4 AS a1, list_sum(list_transform(places, lambda k: cs[k + 1].m2)) / 4 AS a2,
    {_MEAN4.format(f='near')} AS alignment, {_MEAN4.format(f='specific')} AS specificity, 1 - {_MEAN4.format(f='density')} AS low_copy,
    list_sum(list_transform(ps, lambda p: list_sum(list_transform(list_zip(cs[p[1] + 1].u, cs[p[2] + 1].u), lambda z: z[1] * z[2])))) / 6 AS cosine,
    1 - list_sum(list_transform(ps, lambda p: len(list_intersect(cs[p[1] + 1].terms, cs[p[2] + 1].terms))::DOUBLE / len(list_distinct(list_concat(cs[p[1] + 1].terms, cs[p[2] + 1].terms))))) / 6 AS lexical FROM x),
z AS (SELECT *, 0.3 * alignment + 0.25 * least(1, greatest(0, 1 - cosine)) + 0.2 * lexical + 0.15 * specificity + 0.1 * low_copy AS score FROM y WHERE risk <= arisk AND m1 + 1e-12 >= a1 AND m2 + 1e-12 >= a2)
SELECT g, array_to_string(list_transform(items, lambda k: cs[k + 1].id), ',') AS ids, items <> places AS changed, round(score, 9) AS score, round(cosine, 9) AS mean_cosine, round(lexical, 9) AS lexical_diversity FROM z QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, items) = 1""")
def feasible_subsets(spark, d):
    """The four of eight vectors that are as good as the anchor by each metric and score best."""
    from ..operators import selection

    found = selection.feasible_subsets(eights(spark, d), "g", "id", ["m1", "m2"], 2.0)
    return found.select("g", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "changed", *(F.round(c, 9).alias(c) for c in ("score", "mean_cosine", "lexical_diversity")))
