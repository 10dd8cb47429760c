"""Queries of same-prompt groups, pairs, cohorts, records and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import handoff as H
from ..operators import pairs as P
from ..operators import records as R
from ..operators import selection as S
from ..operators import splits
from ..sources import records as sources
from .catalog import _FORM, _PAIRS_SQL, _jaccard, _words, conversation_pairs, query, question_candidates, table

#: An order's lines as candidates for one prompt: price as margin, discount and tax as a shadow judge, flags by status.
_LINES_SQL = """c AS (SELECT l_orderkey AS "group", l_orderkey * 100 + n AS candidate, n AS position, p_name AS query, l_extendedprice::DOUBLE / 1000 AS margin, l_quantity::DOUBLE AS shadow_margin, l_discount::DOUBLE AS shadow_rank, l_returnflag <> 'R' AS chosen_ok, l_quantity > 5 AS rejected_ok, l_tax::DOUBLE AS overlap
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_partkey) AS n FROM lineitem WHERE l_orderkey IS NOT NULL) JOIN part ON p_partkey = l_partkey)"""


def line_candidates(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_partkey")
    lines = table(spark, d, "lineitem").where("l_orderkey is not null").withColumn("n", F.row_number().over(order))
    rows = lines.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    number = lambda c: F.col(c).cast("double")
    return rows.select(
        F.col("l_orderkey").alias("group"), (F.col("l_orderkey") * 100 + F.col("n")).alias("candidate"), F.col("n").alias("position"), F.col("p_name").alias("query"), (number("l_extendedprice") / 1000).alias("margin"),
        number("l_quantity").alias("shadow_margin"), number("l_discount").alias("shadow_rank"), (F.col("l_returnflag") != "R").alias("chosen_ok"), (F.col("l_quantity") > 5).alias("rejected_ok"), number("l_tax").alias("overlap"),
    )


_DIFFERS = _jaccard(f"list_distinct({_words('r.query')})", f"list_distinct({_words('t.query')})", 1.0)


@query(f"""WITH {_LINES_SQL}, tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY margin DESC, position) AS i FROM c WHERE chosen_ok) WHERE i = 1),
o AS (SELECT r."group" AS g, r.candidate AS candidate, r.margin AS margin, r.shadow_margin AS sm, r.shadow_rank AS sr, r.margin <= t.margin - 1.0 AS below, r.margin <= t.margin - 1.0 AND {_DIFFERS} <= 0.85 AS fit, r.position AS position FROM c r JOIN tops t ON r."group" = t."group" WHERE r.rejected_ok AND r.candidate <> t.candidate),
n AS (SELECT g, count(*) AS n, count(*) FILTER (below) AS nb, count(*) FILTER (fit) AS nf FROM o GROUP BY g), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY margin DESC, position) AS i FROM o WHERE fit) WHERE i = 1),
a AS (SELECT g."group" AS "group", t.candidate AS chosen, k.candidate AS rejected, t.margin - k.margin AS gap, CASE WHEN t.candidate IS NULL THEN 'no_chosen' WHEN coalesce(n, 0) = 0 THEN 'no_rejected' WHEN nb = 0 THEN 'no_gap' WHEN nf = 0 THEN 'near_duplicate' WHEN coalesce(t.shadow_margin < k.sm OR t.shadow_rank > k.sr, false) THEN 'shadow_veto' END AS reason
FROM (SELECT DISTINCT "group" FROM c) g LEFT JOIN tops t ON t."group" = g."group" LEFT JOIN n ON n.g = g."group" LEFT JOIN k ON k.g = g."group")
SELECT "group", CASE WHEN reason IS NULL THEN chosen END AS chosen, CASE WHEN reason IS NULL THEN rejected END AS rejected, CASE WHEN reason IS NULL THEN round(gap, 6) END AS margin_gap, reason FROM a""")
def tentative_pairs(spark, d):
    return P.tentative_pairs(line_candidates(spark, d)).withColumn("margin_gap", F.round("margin_gap", 6))


#: The lines with what the pair policy asks: verdicts of all three kinds, gates, round trips and overlap.
_POLICY_SQL = _LINES_SQL.replace("l_tax::DOUBLE AS overlap", "l_tax::DOUBLE AS overlap, l_orderkey % 5 <> 0 AS eligible, CASE WHEN l_quantity::INT % 4 = 0 THEN 'no' WHEN l_quantity::INT % 4 = 1 THEN 'uncertain' ELSE 'yes' END AS verdict, (l_discount::DOUBLE >= 0.02)::INT::DOUBLE AS round_trip, l_quantity::INT % 11 <> 0 AS format_ok, l_returnflag <> 'R' AS clean")
_LIKE = _jaccard("a.ws", "b.ws", 1.0)


def _axis_sql(axis: str, chosen: str, rejected: str) -> str:
    return f"""{axis}c AS (SELECT g, count(*) AS n, arg_min(candidate, (m, position)) AS chosen FROM w WHERE {chosen} GROUP BY g),
{axis}r AS (SELECT g, candidate, position, m FROM w WHERE {rejected}),
{axis}o AS (SELECT r.g AS g, arg_min(r.candidate, (-r.m, r.position)) FILTER (j <= 0.85) AS rejected, count(*) FILTER (r.candidate <> c.chosen) AS others FROM {axis}r r JOIN {axis}c c ON c.g = r.g LEFT JOIN j ON j.a = c.chosen AND j.b = r.candidate GROUP BY r.g),
{axis} AS (SELECT gs.g AS g, chosen, rejected, coalesce(c.n, 0) AS nc, coalesce(rn.n, 0) AS nr, CASE WHEN c.n IS NULL THEN 'no_admissible_chosen' WHEN coalesce(others, 0) = 0 THEN 'no_axis_defect_rejected' WHEN rejected IS NULL THEN 'near_duplicate_query_pair' END AS reason
FROM gs LEFT JOIN {axis}c c ON c.g = gs.g LEFT JOIN {axis}o o ON o.g = gs.g LEFT JOIN (SELECT g, count(*) AS n FROM {axis}r GROUP BY g) rn ON rn.g = gs.g)"""


@query(f"""WITH {_POLICY_SQL}, k AS (SELECT "group" AS g, *, list_distinct({_words("query")}) AS ws FROM c), j AS (SELECT a.g AS g, a.candidate AS a, b.candidate AS b, b.position AS bp, {_LIKE} AS j FROM k a JOIN k b ON a.g = b.g AND a.candidate <> b.candidate),
m AS (SELECT a, list_reduce(list(j ORDER BY bp), lambda x, y: x + y) / count(*) AS m FROM j GROUP BY a), w AS (SELECT k.*, coalesce(m.m, 0) AS m FROM k LEFT JOIN m ON m.a = k.candidate), gs AS (SELECT DISTINCT g, eligible FROM w),
{_axis_sql("A", "verdict = 'yes' AND clean AND true", "format_ok AND (verdict = 'no' OR round_trip < 1)")},
{_axis_sql("B", "verdict = 'yes' AND clean AND overlap <= 0.03", "format_ok AND verdict = 'yes' AND round_trip >= 1 AND overlap >= 0.06")},
t AS (SELECT gs.g AS g, eligible, ('0x' || substr(sha256('axis' || chr(0) || gs.g::VARCHAR), 16, 1))::INT % 2 = 0 AS af, A.chosen AS ac, A.rejected AS ar, A.reason AS ae, 'A/' || A.nc || '/' || A.nr || '/' || coalesce(A.reason, 'made') AS al, B.chosen AS bc, B.rejected AS br, B.reason AS be, 'B/' || B.nc || '/' || B.nr || '/' || coalesce(B.reason, 'made') AS bl FROM gs JOIN A ON A.g = gs.g JOIN B ON B.g = gs.g),
u AS (SELECT *, CASE WHEN NOT eligible THEN NULL WHEN af AND ae IS NULL THEN 'A' WHEN NOT af AND be IS NULL THEN 'B' WHEN ae IS NULL THEN 'A' WHEN be IS NULL THEN 'B' END AS axis FROM t)
SELECT u.g AS "group", CASE WHEN af THEN 'A,B' ELSE 'B,A' END AS axis_order, CASE WHEN NOT u.eligible THEN '' WHEN af THEN al || CASE WHEN ae IS NULL THEN '' ELSE ';' || bl END ELSE bl || CASE WHEN be IS NULL THEN '' ELSE ';' || al END END AS attempts, axis,
CASE axis WHEN 'A' THEN ac WHEN 'B' THEN bc END AS chosen, CASE axis WHEN 'A' THEN ar WHEN 'B' THEN br END AS rejected, round(x.m, 9) AS chosen_distinctness, round(y.m, 9) AS rejected_typicality, round(x.margin - y.margin, 6) AS margin_delta,
CASE WHEN NOT u.eligible THEN 'group_not_gate_eligible' WHEN axis IS NOT NULL THEN '' ELSE array_to_string(list_sort(list_distinct([ae, be])), ',') END AS failure_reasons
FROM u LEFT JOIN w x ON x.candidate = CASE axis WHEN 'A' THEN ac WHEN 'B' THEN bc END LEFT JOIN w y ON y.candidate = CASE axis WHEN 'A' THEN ar WHEN 'B' THEN br END""")
def defect_pairs(spark, d):
    """Groups try both axes in turn, with verdicts yes, no and uncertain, and log what failed."""
    quantity = F.round(F.col("shadow_margin")).cast("int")
    verdict = F.when(quantity % 4 == 0, "no").when(quantity % 4 == 1, "uncertain").otherwise("yes")
    rows = line_candidates(spark, d).select(
        "group", (F.col("group") % 5 != 0).alias("eligible"), "candidate", "position", "query", F.lit("p").alias("prompt"), verdict.alias("verdict"), F.col("chosen_ok").alias("clean"), (quantity % 11 != 0).alias("format_ok"),
        (F.col("shadow_rank") >= 0.02).cast("double").alias("round_trip"), "overlap", "margin", F.array(F.lit("d")).alias("defects"),
    )
    found = P.defect_pairs(rows, "axis", (0.03, 0.06))
    tried = F.transform("attempts", lambda a: F.concat_ws("/", a["axis"], a["n_chosen"].cast("string"), a["n_rejected"].cast("string"), F.coalesce(a["failure_reason"], F.lit("made"))))
    return found.select(
        "group", F.array_join("axis_order", ",").alias("axis_order"), F.array_join(tried, ";").alias("attempts"), "axis", "chosen", "rejected", F.round("chosen_distinctness", 9).alias("chosen_distinctness"), F.round("rejected_typicality", 9).alias("rejected_typicality"),
        F.round("margin_delta", 6).alias("margin_delta"), F.array_join("failure_reasons", ",").alias("failure_reasons"),
    )


@query(f"""WITH {_LINES_SQL}, k AS (SELECT "group" AS g, candidate, coalesce(chosen_ok, false) AS clean, list_distinct({_words("query")}) AS ws, unnest(list_filter([CASE WHEN NOT rejected_ok THEN 'small' END, CASE WHEN overlap >= 0.06 THEN 'taxed' END, 'any'], lambda z: z IS NOT NULL)) AS defect FROM c),
e AS (SELECT defect, g, count(*) AS n FROM k WHERE defect <> 'any' GROUP BY 1, 2), p AS (SELECT DISTINCT b.defect AS defect, b.g AS g FROM k b JOIN k a ON a.g = b.g AND a.defect = 'any' AND a.clean AND a.candidate <> b.candidate AND b.defect <> 'any' AND {_LIKE} <= 0.85)
SELECT e.defect AS defect, sum(n)::BIGINT AS candidates, count(*) AS groups, count(p.g) AS pairable_groups FROM e LEFT JOIN p ON p.g = e.g AND p.defect = e.defect GROUP BY e.defect""")
def defect_supply(spark, d):
    return P.defect_supply(line_candidates(spark, d), {"small": ~F.col("rejected_ok"), "taxed": F.col("overlap") >= 0.06}, F.col("chosen_ok"))


@query()
def diversity_gates(spark, d):
    """Gates of a conversation's questions; against plain Python in the tests."""
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text", F.lit("one prompt").alias("prompt"))
    return P.diversity_gate(splits.group_clusters(rows, "conv_id", "turn", "text", 0.9), "conv_id", "turn", "text", "prompt", 2, 2)


@query(f"WITH {_PAIRS_SQL} SELECT conv_id, turn, substr(sha256('v1' || chr(0) || query || chr(0) || answer), 1, 24) AS item FROM pairs")
def verdict_items(spark, d):
    return conversation_pairs(spark, d).select("conv_id", "turn", P.verdict_id("v1", F.col("query"), F.col("answer")).alias("item"))


@query("SELECT l_orderkey, CASE WHEN min(l_orderkey % 3) = 0 THEN 'yes' ELSE 'no' END AS verdict, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1")
def journal_verdicts(spark, d):
    rows = table(spark, d, "lineitem").where("l_orderkey is not null").select("l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, "yes").otherwise("no").alias("verdict"))
    return P.verdicts(rows, "l_orderkey", "verdict")


@query(f"""WITH {_PAIRS_SQL}, h AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS id FROM pairs), w AS (SELECT id, ('0x' || substr(sha256('blind:' || id), 1, 2))::INT >= 128 AS swapped FROM h), a AS (SELECT id, r, CASE WHEN ('0x' || substr(md5(r || id), 1, 2))::INT % 3 = 0 THEN 'tie' WHEN ('0x' || substr(md5(r || id), 1, 2))::INT % 3 = 1 THEN 'a' ELSE 'b' END AS picked FROM h, unnest(['x', 'y', 'z']) AS u(r)),
p AS (SELECT a.id AS id, CASE WHEN picked = 'tie' THEN 'tie' WHEN (picked = 'a') <> swapped THEN 'left' ELSE 'right' END AS prefers FROM a JOIN w ON a.id = w.id), c AS (SELECT id, prefers, count(*) AS c FROM p GROUP BY 1, 2), g AS (SELECT id, sum(c)::BIGINT AS raters, max(c) AS top, arg_max(prefers, c) AS best FROM c GROUP BY 1)
SELECT id, raters, CASE WHEN top = raters THEN 'unanimous' WHEN 2 * top > raters THEN 'majority' ELSE 'split' END AS state, CASE WHEN 2 * top > raters THEN best END AS preferred FROM g""")
def blind_audit(spark, d):
    """Export, made-up answers by digest, commitments checked, and what the raters agree on."""
    rows = conversation_pairs(spark, d).withColumn("id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    out = S.blind_export(rows, "id", "query", "answer", "blind")
    pick = F.conv(F.substring(F.md5(F.concat("rater", "id")), 1, 2), 16, 10).cast("int") % 3
    answers = out.select("id", F.explode(F.array(*map(F.lit, "xyz"))).alias("rater")).withColumn("picked", F.when(pick == 0, "tie").when(pick == 1, "a").otherwise("b"))
    return P.consensus(P.unblinded(out, answers, "id", "blind"), "id")


@query("""SELECT d.doc_id AS doc_id, l.quality AS quality, b.n AS n_pages, list_filter([CASE WHEN l.doc_id IS NULL THEN 'label' END, CASE WHEN b.i IS NULL THEN 'page' END], lambda x: x IS NOT NULL)::VARCHAR AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT page_id AS i, length(html) AS n FROM pages) b ON b.i = d.doc_id""")
def candidate_evidence(spark, d):
    parts = {"label": table(spark, d, "labels").select("doc_id", "quality"), "page": table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.length("html").cast("long").alias("n"))}
    found = P.evidence(table(spark, d, "documents").select("doc_id"), parts, "doc_id")
    return found.select("doc_id", F.col("label.quality").alias("quality"), F.col("page.n").alias("n_pages"), F.concat(F.lit("["), F.array_join("missing", ", "), F.lit("]")).alias("missing"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(abs(l_extendedprice::DOUBLE / 1000 - (l_quantity::DOUBLE - l_discount::DOUBLE)) > 20, true)""")
def margin_mismatches(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice").cast("double") / 1000).alias("m"), F.col("l_quantity").cast("double").alias("c"), F.col("l_discount").cast("double").alias("r"))
    return P.margin_mismatches(rows, "m", "c", "r", 20).select("l_orderkey", "l_linenumber")


@query("""WITH g AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS present, count(l_linenumber) - count(DISTINCT l_linenumber) AS repeated, count(*) FILTER (l_tax IS NULL) AS incomplete, list_filter(range(4), lambda s: NOT list_contains(list(l_linenumber - 1), s)) AS missing FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1)
SELECT l_orderkey, present, repeated, incomplete, len(missing)::INT AS missing FROM g WHERE len(missing) > 0 OR repeated > 0 OR incomplete > 0""")
def slot_gaps(spark, d):
    rows = table(spark, d, "lineitem").where("l_orderkey is not null").select("l_orderkey", (F.col("l_linenumber") - 1).alias("slot"), "l_tax")
    return P.slot_gaps(rows, "l_orderkey", "slot", 4, ["l_tax"]).withColumn("missing", F.size("missing"))


@query("""SELECT user_id, 'event_type' AS field, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1 UNION ALL SELECT user_id, 'props', count(DISTINCT props) FROM events GROUP BY 1 HAVING count(DISTINCT props) > 1""")
def identity_conflicts(spark, d):
    return P.identity_conflicts(table(spark, d, "events"), "user_id", ["event_type", "props"])


# selection


@query()
def unique_cohort(spark, d):
    """Orders of which no two share a customer or a price band; against one pass in order in the tests."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 500).alias("band"))
    return S.unique_cohort(rows, "o_custkey", "band", "o_orderkey", 100, "cohort")


_ORDER = "sha256('{s}:' || o_orderkey::VARCHAR), o_orderkey"


@query(f"""WITH r AS (SELECT o_orderkey, o_totalprice::DOUBLE AS s, o_custkey::DOUBLE AS m, o_orderstatus = 'P' AS f FROM orders), q AS (SELECT list(s ORDER BY s) AS ss, list(m ORDER BY m) AS mm FROM r WHERE s IS NOT NULL AND m IS NOT NULL),
x AS (SELECT r.*, coalesce(s <= ss[ceil(len(ss) * 0.1)::BIGINT], false) AS ls, coalesce(m <= mm[ceil(len(mm) * 0.1)::BIGINT], false) AS lm FROM r, q),
a AS (SELECT o_orderkey FROM x WHERE ls ORDER BY {_ORDER.format(s='audit-low_score')} LIMIT 30), b AS (SELECT o_orderkey FROM x WHERE lm AND o_orderkey NOT IN (FROM a) ORDER BY {_ORDER.format(s='audit-low_margin')} LIMIT 30),
c AS (SELECT o_orderkey FROM x WHERE coalesce(f, false) AND o_orderkey NOT IN (FROM a) AND o_orderkey NOT IN (FROM b) ORDER BY {_ORDER.format(s='audit-flagged')} LIMIT 30), e AS (SELECT o_orderkey FROM x WHERE o_orderkey NOT IN (FROM a) AND o_orderkey NOT IN (FROM b) AND o_orderkey NOT IN (FROM c) ORDER BY {_ORDER.format(s='audit-control')} LIMIT 30)
SELECT o_orderkey, 'low_score' AS stratum FROM a UNION ALL SELECT o_orderkey, 'low_margin' FROM b UNION ALL SELECT o_orderkey, 'flagged' FROM c UNION ALL SELECT o_orderkey, 'control' FROM e""")
def audit_strata(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("s"), F.col("o_custkey").cast("double").alias("m"), (F.col("o_orderstatus") == "P").alias("f"))
    return S.audit_strata(rows, "o_orderkey", "s", "m", "f", 30, "audit")


@query(f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_ORDER.format(s='axes')}) AS i FROM orders) SELECT o_orderkey, o_orderstatus FROM r WHERE i <= CASE o_orderstatus WHEN 'F' THEN 20 WHEN 'O' THEN 30 WHEN 'P' THEN 10 ELSE 0 END""")
def axis_sample(spark, d):
    return S.sample_by_axis(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", {"F": 20, "O": 30, "P": 10}, "axes")


@query(f"""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_ORDER.format(s='ex')}) AS i FROM orders WHERE o_totalprice >= 100000 AND o_custkey > 100) SELECT o_orderkey, o_orderpriority FROM r WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND i <= 4""")
def exemplars(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") >= 100000).cast("double").alias("sure"), "o_custkey")
    taken = rows.where("o_custkey <= 100 or o_custkey is null").select("o_orderkey")
    return S.exemplars(rows, "o_orderpriority", "sure", "o_orderkey", {"1-URGENT": 4, "5-LOW": 4}, taken, "ex").select("o_orderkey", "o_orderpriority")


@query("SELECT item_id, s::INT AS slot, ['question', 'keywords', 'sentence'][s % 3 + 1] AS form, ['fact', 'definition'][s % 2 + 1] AS intent FROM benchmark, unnest(range(8)) AS u(s)")
def control_matrix(spark, d):
    return S.control_matrix(table(spark, d, "benchmark"), "item_id", {"form": ("question", "keywords", "sentence"), "intent": ("fact", "definition")}, 8)


@query("""WITH s AS (SELECT DISTINCT lang, source, doc_id FROM documents), h AS (SELECT *, sha256('plan:' || concat_ws(':', doc_id::VARCHAR, lang, source)) AS h FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) + row_number() OVER (PARTITION BY source ORDER BY h) AS r FROM h) SELECT doc_id, lang, source FROM r ORDER BY r, h LIMIT 60""")
def request_plan(spark, d):
    return S.request_plan(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 60)


@query("SELECT s_suppkey, s_acctbal, s_nationkey, row_number() OVER (ORDER BY s_nationkey DESC, s_acctbal DESC, s_suppkey) AS rank FROM supplier WHERE s_nationkey IS NOT NULL AND s_acctbal IS NOT NULL")
def variant_ranking(spark, d):
    return S.measured_ranking(table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), "s_suppkey", ["s_nationkey", "s_acctbal"])


@query()
def searched_rule(spark, d):
    """Which two tests on price and quantity tell returned lines; against all pairs in the tests."""
    rows = table(spark, d, "lineitem").where("l_returnflag is not null").select((F.col("l_returnflag") == "R").alias("gold"), *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")))
    return S.rule_search(rows, "gold", ["l_quantity", "l_discount", "l_tax"], 0.1, 0.05, 4)


_UNIFORM = "('0x' || substr(md5('over:' || o_orderkey::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"""WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT o_orderkey, o.o_orderstatus AS o_orderstatus, (SELECT max(n) FROM c)::DOUBLE / n AS w FROM orders o JOIN c ON c.o_orderstatus = o.o_orderstatus),
t AS (SELECT o_orderkey, o_orderstatus, (floor(w) + ({_UNIFORM} < w - floor(w))::INT)::BIGINT AS t FROM w) SELECT o_orderkey, o_orderstatus, unnest(range(1, t + 1)) AS copy FROM t""")
def oversampled(spark, d):
    return S.oversampled(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", "over")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY sha256('next:' || doc_id::VARCHAR), doc_id LIMIT 25 OFFSET 10""")
def prospective_cohort(spark, d):
    return S.prospective_cohort(table(spark, d, "documents").select("doc_id"), [table(spark, d, "labels")], "doc_id", "next", 10, 25).select("doc_id")


@query()
def best_subsets(spark, d):
    """Two questions of a conversation by length and new terms; against all pairs in the tests."""
    return S.best_subset(question_candidates(spark, d), "conv_id", "turn", "quality", 2, "terms", (0.5, 0.5))


# records and fingerprints


@query("""WITH e AS (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_quantity >= 40) AS good FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1, 2, 3), d AS (SELECT l_suppkey, l_orderkey, bool_or(good) AS good FROM e GROUP BY 1, 2)
SELECT l_suppkey::VARCHAR AS example_id, count(*) FILTER (good) AS n_positives, count(*) FILTER (NOT good) AS n_negatives FROM d GROUP BY 1 HAVING count(*) FILTER (good) > 0""")
def judged_records(spark, d):
    rows = table(spark, d, "lineitem").where("l_suppkey is not null").select("l_suppkey", F.lit("q").alias("q"), "l_orderkey", F.col("l_orderkey").cast("string").alias("t"), (F.col("l_quantity") >= 40).alias("good"))
    found = R.judged_records(rows, "l_suppkey", "q", "l_orderkey", "t", "good")
    return found.select("example_id", F.size("positives").cast("long").alias("n_positives"), F.size("hard_negatives").cast("long").alias("n_negatives"))


@query("""SELECT l_suppkey AS example_id, count(*) FILTER (l_quantity >= 23.5) AS n_kept, md5(coalesce(string_agg(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR) FILTER (l_quantity < 23.5 OR l_quantity IS NULL), '')) AS removed FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (l_quantity >= 23.5) > 0""")
def filtered_records(spark, d):
    doc = F.struct(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("doc_id"), F.lit("t").alias("text"), F.col("l_quantity").cast("double").alias("score"))
    rows = table(spark, d, "lineitem").where("l_orderkey is not null and l_linenumber is not null").groupBy(F.col("l_suppkey").alias("example_id")).agg(F.array_sort(F.collect_list(doc)).alias("positives"))
    return R.filtered_records(rows).select("example_id", F.size("positives").cast("long").alias("n_kept"), F.md5(F.array_join("removed_ids", ",")).alias("removed"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY sha256('shards:' || o_orderkey::VARCHAR), o_orderkey) - 1) AS ordinal, ((row_number() OVER (ORDER BY sha256('shards:' || o_orderkey::VARCHAR), o_orderkey) - 1) // 500)::BIGINT AS shard FROM orders")
def shard_plan(spark, d):
    return R.shard_plan(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, "shards")


@query("""WITH k AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT k, (row_number() OVER (ORDER BY sha256('mix:' || k::VARCHAR), k) - 1) % 2 AS odd FROM k WHERE k IS NOT NULL)
SELECT o_orderkey, o_custkey, CASE WHEN odd = 0 THEN 'natural' ELSE 'synthetic' END AS kind FROM orders JOIN n ON k = o_custkey WHERE (odd = 0 AND o_orderstatus = 'O') OR (odd = 1 AND o_orderstatus = 'F')""")
def mixed_cohort(spark, d):
    rows = table(spark, d, "orders").where("o_custkey is not null").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.mixed_cohort(rows.where("o_orderstatus = 'O'"), rows.where("o_orderstatus = 'F'"), "o_custkey", "mix").select("o_orderkey", "o_custkey", "kind")


_ROW = """'{{"doc_id":' || coalesce(doc_id::VARCHAR, 'null') || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}}'""".replace("{{", "{").replace("}}", "}")


@query(f"""WITH h AS (SELECT sha256({_ROW}) AS h FROM documents), p AS (SELECT substr(h, 1, 3) AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM p""")
def records_digest(spark, d):
    return R.records_digest(table(spark, d, "documents"), ["doc_id", "lang", "source"])


@query(f"""WITH h AS (SELECT doc_id AS o, sha256({_ROW}) AS h FROM documents), p AS (SELECT o // 1000 AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY o)) AS d FROM h GROUP BY 1), t AS (SELECT b // 1000 AS t, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY b)) AS d FROM p GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY t)) AS digest FROM t""")
def ordered_digest(spark, d):
    return R.ordered_digest(table(spark, d, "documents"), "doc_id", ["doc_id", "lang", "source"])


@query("""SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL THEN 'c_custkey' ELSE 'c_nationkey' END AS fields FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey WHERE c.c_custkey IS NULL OR c.c_nationkey IS DISTINCT FROM o_custkey % 25""")
def request_drift(spark, d):
    asked = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    made = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_custkey") % 25).alias("c_nationkey"))
    found = R.drift(asked, made.drop("o_orderkey").distinct(), "c_custkey", ["c_nationkey"])
    return made.join(found.select(F.col("c_custkey").alias("k"), "fields"), F.col("c_custkey").eqNullSafe(F.col("k"))).select("o_orderkey", F.array_join("fields", ",").alias("fields"))


@query("""WITH n AS (SELECT md5(text) AS m, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS n_texts, sum(n)::BIGINT AS n_items FROM n""")
def packed_passages(spark, d):
    """Items and a dictionary of their different texts, and back."""
    dictionary, items = sources.packets(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    back = sources.unpacked(dictionary, items, "text")
    return back.agg(F.count_distinct("text").alias("n_texts"), F.count(F.lit(1)).alias("n_items"))


@query("""SELECT event_id, greatest(0, coalesce(60 - (epoch_us(ts) - epoch_us(lag(ts, 3) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1e6, 0))::DOUBLE AS wait_seconds FROM events""")
def request_spacing(spark, d):
    return R.budget_spacing(table(spark, d, "events"), "event_type", "ts", "event_id", 3).select("event_id", "wait_seconds")


@query(rf"WITH {_PAIRS_SQL} SELECT conv_id, turn, lower(trim(regexp_replace(query, '\s+', ' ', 'g'))) = {_FORM.format(c='query')} AS same, length(answer)::BIGINT AS n FROM pairs")
def prompts(spark, d):
    """Prompts hold what is asked, the controls and the passage."""
    made = R.prompt(F.col("answer"), {"forma": F.lit("pytanie")}, F.array(F.col("query")))
    whole = F.contains(made, F.btrim("answer")) & F.contains(made, F.col("query")) & F.contains(made, F.lit("forma: pytanie")) & made.startswith(R.ASK)
    return conversation_pairs(spark, d).select("conv_id", "turn", whole.alias("same"), F.length("answer").cast("long").alias("n"))



# export and hand-off

#: Conversations as candidate sets: the longest answer is chosen, the others are rejected; some of them are odd on purpose.
_SETS_SQL = """cand AS (SELECT conv_id * 100 + turn AS candidate_id, conv_id, turn, CASE WHEN conv_id % 10 < 8 THEN 'train' ELSE 'dev' END AS split, conv_id AS passage_id, text AS query FROM conversations WHERE role <> 'system' AND text IS NOT NULL),
sets AS (SELECT conv_id AS set_id, CASE WHEN conv_id % 10 < 8 THEN 'train' ELSE 'dev' END AS split, conv_id + (conv_id % 13 = 0)::INT AS passage_id, arg_max(candidate_id, (length(query), -turn)) AS chosen_id, list(candidate_id ORDER BY turn) AS ids FROM cand GROUP BY conv_id),
kept AS (SELECT * FROM cand WHERE candidate_id % 17 <> 0), r AS (SELECT set_id, split, passage_id, chosen_id, unnest(list_filter(ids, lambda x: x <> chosen_id)) AS rejected_id FROM sets),
x AS (SELECT r.*, c.query AS cq, c.split AS cs, c.passage_id AS cp, j.query AS rq, j.split AS js, j.passage_id AS jp FROM r LEFT JOIN kept c ON c.candidate_id = r.chosen_id LEFT JOIN kept j ON j.candidate_id = r.rejected_id)"""


def candidate_sets(spark, d):
    """(candidates, sets): a seventeenth of the candidates is missing, a thirteenth of the sets is of another passage."""
    split = F.when(F.col("conv_id") % 10 < 8, "train").otherwise("dev")
    cand = table(spark, d, "conversations").where("role <> 'system' and text is not null").select((F.col("conv_id") * 100 + F.col("turn")).alias("candidate_id"), "conv_id", "turn", split.alias("split"), F.col("conv_id").alias("passage_id"), F.col("text").alias("query"))
    g = cand.groupBy("conv_id").agg(F.max_by("candidate_id", F.struct(F.length("query"), -F.col("turn"))).alias("chosen_id"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "candidate_id"))), lambda x: x["candidate_id"]).alias("ids"))
    others = F.filter("ids", lambda x: x != F.col("chosen_id"))
    sets = g.select(F.col("conv_id").alias("set_id"), split.alias("split"), (F.col("conv_id") + (F.col("conv_id") % 13 == 0).cast("int")).alias("passage_id"), F.lit("p").alias("prompt"), "chosen_id", others.alias("rejected_ids"), F.transform(others, lambda x: F.lit(1.0)).alias("margins"))
    return cand.where("candidate_id % 17 <> 0").drop("conv_id", "turn"), sets


@query(f"""WITH {_SETS_SQL} SELECT set_id, rejected_id, unnest(list_filter([CASE WHEN cq IS NULL THEN 'missing_chosen' END, CASE WHEN rq IS NULL THEN 'missing_rejected' END, CASE WHEN cq IS NOT NULL AND (cs <> split OR cp <> passage_id) THEN 'chosen_drift' END,
CASE WHEN rq IS NOT NULL AND (js <> split OR jp <> passage_id) THEN 'rejected_drift' END, CASE WHEN lower(cq) = lower(rq) THEN 'identical_pair' END], lambda z: z IS NOT NULL)) AS fault FROM x""")
def export_faults(spark, d):
    return H.export_faults(*candidate_sets(spark, d))


@query(f"""WITH {_SETS_SQL} SELECT set_id || '::' || rejected_id AS preference_id, split, chosen_id, rejected_id, md5(cq) AS chosen, md5(rq) AS rejected FROM x WHERE cq IS NOT NULL AND rq IS NOT NULL""")
def preference_rows(spark, d):
    found = H.preference_rows(*candidate_sets(spark, d)).where("chosen is not null and rejected is not null")
    return found.select("preference_id", "split", "chosen_id", "rejected_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


@query(f"""WITH {_SETS_SQL} SELECT s.split AS split, chosen_id AS candidate_id, s.passage_id AS passage_id, md5(query) AS completion FROM sets s JOIN kept ON candidate_id = chosen_id""")
def continued_rows(spark, d):
    return H.continued_rows(*candidate_sets(spark, d)).select("split", "candidate_id", "passage_id", F.md5("completion").alias("completion"))


@query(f"""WITH {_SETS_SQL}, q AS (SELECT lower(cq) AS q, 1 AS c, 0 AS r FROM x WHERE cq IS NOT NULL AND rq IS NOT NULL UNION ALL SELECT lower(rq), 0, 1 FROM x WHERE cq IS NOT NULL AND rq IS NOT NULL), g AS (SELECT q, sum(c)::BIGINT AS c, sum(r)::BIGINT AS r FROM q GROUP BY q HAVING sum(c) = 0 OR sum(r) = 0)
SELECT count(*) AS queries, sum(c)::BIGINT AS chosen, sum(r)::BIGINT AS rejected FROM g""")
def one_sided_queries(spark, d):
    found = H.one_sided(H.preference_rows(*candidate_sets(spark, d)).where("chosen is not null and rejected is not null"))
    return found.agg(F.count(F.lit(1)).alias("queries"), F.sum("chosen").alias("chosen"), F.sum("rejected").alias("rejected"))


def packages(spark, d):
    """(preferences, controls, weights) of orders, with faults planted by order key."""
    k = F.col("o_orderkey")
    base = table(spark, d, "orders").where("o_orderkey is not null").select(
        k.alias("preference_id"), k.alias("place"), F.when(k % 10 < 8, "train").otherwise("dev").alias("split"), F.concat(F.lit("p"), k.cast("string")).alias("prompt"), F.concat(F.lit("c"), k.cast("string")).alias("chosen"), k.alias("chosen_id"),
        F.floor(k / 3).alias("passage_id"), F.floor(k / 9).alias("cluster_id"), F.when(k % 97 == 0, "v2").otherwise("v1").alias("provenance"),
    )
    controls = base.where("preference_id % 101 <> 0").withColumnsRenamed({"chosen": "completion", "chosen_id": "candidate_id"}).withColumn("completion", F.when(F.col("preference_id") % 89 == 0, "other").otherwise(F.col("completion")))
    weights = base.select("preference_id", (F.col("place") + F.when(F.col("preference_id") % 83 == 0, 1000).otherwise(0)).alias("place"), "split", "provenance", F.when(F.col("preference_id") % 79 == 0, "w2").otherwise("w1").alias("weight_policy"), F.when(F.col("preference_id") % 73 == 0, F.lit(None)).otherwise(1.0).alias("sample_weight"))
    return base, controls, weights


@query("""WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'dev' END AS split, CASE WHEN o_orderkey % 97 = 0 THEN 'v2' ELSE 'v1' END AS provenance FROM orders WHERE o_orderkey IS NOT NULL),
p AS (SELECT *, row_number() OVER (ORDER BY split = 'dev', k) AS i FROM b), c AS (SELECT k, row_number() OVER (ORDER BY split = 'dev', k) AS i FROM b WHERE k % 101 <> 0), w AS (SELECT k, row_number() OVER (ORDER BY split = 'dev', k + CASE WHEN k % 83 = 0 THEN 1000 ELSE 0 END, k) AS i FROM b),
f AS (SELECT p.k AS k, unnest(list_filter([CASE WHEN provenance = 'v2' THEN 'provenance' END, CASE WHEN c.k IS NULL THEN 'missing_control' END, CASE WHEN p.i <> c.i THEN 'control_order' END, CASE WHEN p.i <> w.i THEN 'weight_order' END, CASE WHEN c.k % 89 = 0 THEN 'control_completion' END, CASE WHEN p.k % 79 = 0 THEN 'weight_policy' END, CASE WHEN p.k % 73 = 0 THEN 'bad_weight' END], lambda z: z IS NOT NULL)) AS fault FROM p LEFT JOIN c ON c.k = p.k LEFT JOIN w ON w.k = p.k)
SELECT k::VARCHAR AS preference_id, fault FROM f WHERE fault NOT LIKE '%_order' UNION ALL SELECT (k // 3)::VARCHAR, 'passage_leak' FROM b GROUP BY k // 3 HAVING count(DISTINCT split) > 1 UNION ALL SELECT (k // 9)::VARCHAR, 'cluster_leak' FROM b GROUP BY k // 9 HAVING count(DISTINCT split) > 1
UNION ALL SELECT count(*)::VARCHAR, fault FROM f WHERE fault = 'control_order' GROUP BY fault""")
def handoff_faults(spark, d):
    """What is wrong with a package of orders; moved controls as a count, for one missing row moves all after it. Moved weights tie by place,
    so that the tests look at these."""
    found = H.handoff_faults(*packages(spark, d), policy="w1")
    moved = found.where("fault = 'control_order'").groupBy("fault").agg(F.count(F.lit(1)).cast("string").alias("preference_id"))
    return found.where("fault not like '%_order'").unionByName(moved.select("preference_id", "fault"))


_EVIDENCE = {"primary": 7, "shadow": 11, "corpus": 13, "lexical": 17, "focus": 19, "style": 23, "format": 29}


@query(f"""WITH d AS (SELECT doc_id AS k, lang, source FROM documents WHERE doc_id IS NOT NULL), f AS ({" UNION ALL ".join(
    f"SELECT k, '{n}' AS component, unnest(list_filter([CASE WHEN k % {m} = 0 THEN 'missing' END, CASE WHEN k % {m} = 1 THEN 'duplicate' END, CASE WHEN k % {m} = 2 AND lang IS DISTINCT FROM 'xx' THEN 'identity_lang' END" + (f", CASE WHEN k % {m} = 3 THEN 'judge_drift' END, CASE WHEN k % {m} = 4 THEN 'incorrect_margin' END" if n in ("primary", "shadow") else "") + (f", CASE WHEN k % {m} = 3 AND k % 2 = 0 THEN 'format_drift' END" if n == "format" else "") + "], lambda z: z IS NOT NULL)) AS fault FROM d" for n, m in _EVIDENCE.items())})
SELECT * FROM f UNION ALL SELECT k, 'primary and shadow', 'mixed_scales' FROM d WHERE k % 7 <> 0 AND k % 11 = 5""")
def evidence_faults(spark, d):
    """Seven components of documents, each with rows that are missing, repeated or of another identity; two judges with drift."""
    docs = table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("k"), "lang", (F.col("doc_id") % 2 == 0).alias("even"))
    parts = {}
    for n, m in _EVIDENCE.items():
        k = F.col("k")
        rows = docs.where(k % m != 0).withColumn("copy", F.explode(F.when(k % m == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("k", F.when(k % m == 2, "xx").otherwise(F.col("lang")).alias("lang"), "even")
        if n in ("primary", "shadow"):
            scale = F.when(k % 11 == 5, "primary").otherwise("shadow") if n == "shadow" else F.lit("primary")
            rows = rows.select("k", "lang", F.lit(n).alias("judge_id"), F.when(k % m == 3, "old").otherwise("r1").alias("judge_revision"), F.when(k % m == 4, 3.0).otherwise(1.0).alias("margin"), F.lit(2.0).alias("positive_score"), F.lit(1.0).alias("max_negative_score"), scale.alias("raw_score_scale_id"))
        if n == "format":
            rows = rows.select("k", "lang", F.when((k % m == 3) & F.col("even"), ~F.col("even")).otherwise(F.col("even")).alias("valid"))
        parts[n] = rows.drop("even")
    cand = docs.select("k", "lang", F.when(F.col("even"), F.lit(True)).alias("format_valid"))
    return H.evidence_faults(cand, parts, "k", ["lang"], {"primary": ("primary", "r1"), "shadow": ("shadow", "r1")})


@query("""SELECT 'quality' AS flag, coalesce(quality::VARCHAR, 'null') AS value, count(*) AS n FROM labels GROUP BY 2 UNION ALL SELECT 'toxic', coalesce(toxic::VARCHAR, 'null'), count(*) FROM labels GROUP BY 2 UNION ALL SELECT 'lang', coalesce(lang, 'null'), count(*) FROM documents GROUP BY 2""")
def flag_histograms(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents")
    return H.flag_histograms({"quality": (labels, F.col("quality")), "toxic": (labels, F.col("toxic")), "lang": (docs, F.col("lang"))})
