"""Queries of text keys, sentences, focus labels and copying."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import lexical as X
from ..functions import text as T
from ..operators import records, validation
from .catalog import _EARLY, _FORM, _LATE, _PAIRS_SQL, _RECORDS_SQL, _content, _jaccard, _list, _starts, _tokens, _words, conversation_pairs, conversation_records, query, table

_LF, _TAB = "chr(10)", "chr(9)"
#: Sentences in SQL, which has no look-behind: a mark after the cut, then a split.
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"
_JUDGE_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\s+([A-ZĄĆĘŁŃÓŚŹŻ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"


@query(f"""SELECT doc_id, len({_SENTENCES.format(c='text')})::BIGINT AS n_sentences, len({_JUDGE_SENTENCES.format(c='text')})::BIGINT AS n_judge_sentences,
    coalesce(list_max(list_transform({_SENTENCES.format(c='text')}, lambda x: length(x))), 0)::BIGINT AS longest FROM documents""")
def sentence_counts(spark, d):
    both = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"), T.judge_sentences(F.col("text")).alias("j"))
    longest = F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0))
    return both.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size("j").cast("long").alias("n_judge_sentences"), longest.cast("long").alias("longest"))


@query()
def careful_sentence_counts(spark, d):
    """Sentences with abbreviations, initials and numbers in mind; against a plain loop in the tests."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.careful_sentences(F.col("text"))).alias("n"))


@query(rf"""SELECT doc_id, array_to_string(list_slice(list_filter(string_split_regex(trim(regexp_replace({_SENTENCES.format(c='text')}[1], '\s+', ' ', 'g')), ' '), lambda w: w <> ''), 1, 12), ' ') AS copied FROM documents WHERE len({_SENTENCES.format(c='text')}) > 0""")
def copied_openings(spark, d):
    return table(spark, d, "documents").where(F.size(T.sentences(F.col("text"))) > 0).select("doc_id", T.first_words(F.col("text")).alias("copied"))


@query()
def query_keys(spark, d):
    """The first turn of each key by which queries are the same; against Python's own folding in the tests."""
    from ..operators.splits import first_of_key

    rows = table(spark, d, "conversations").select(F.concat_ws(":", F.format_string("%012d", "conv_id"), F.format_string("%06d", "turn")).alias("at"), "text").withColumn("key", T.query_key("text"))
    return first_of_key(rows, F.col("key"), "at").select("at", "key")


@query(r"""SELECT conv_id, turn, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND NOT regexp_matches(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[\n\r]') THEN trim(regexp_replace(text, '\s+', ' ', 'g')) END AS line,
    regexp_matches(trim(regexp_replace(text, '\s+', ' ', 'g')), '^(?i:ot(?:o|óż))(?:[^\p{L}\p{N}_]|$)') AS lead_in, regexp_matches(text, '\p{Lu}[\p{L}]+(?:[ -]\p{Lu}[\p{L}]+)+') AS proper_name FROM conversations""")
def completion_lines(spark, d):
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.single_line(text).alias("line"), T.has_lead_in(text).alias("lead_in"), T.has_proper_name(text).alias("proper_name"))


_CONF = lambda c: f"CASE WHEN len({_words(c)}) > 0 THEN len(list_filter({_words(c)}, lambda x: list_contains({_list(T.POLISH_COMMON)}, x) OR regexp_matches(x, '[{T.POLISH_LETTERS}]')))::DOUBLE / len({_words(c)}) ELSE 0 END"
_N = lambda c: f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"


@query(rf"""WITH {_PAIRS_SQL}, j AS (SELECT *, query || chr(10) || answer AS t FROM pairs),
m AS (SELECT conv_id, turn, query, answer, ({' + '.join(f"(length(t) - length(replace(t, '{x}', '')))" for x in T.MOJIBAKE[:3])})::BIGINT AS mojibake_markers, (length(t) - length(replace(t, '{T.MOJIBAKE[3]}', '')))::BIGINT AS replacements,
    (length(t) - length(regexp_replace(replace(replace(t, {_LF}, 'x'), {_TAB}, 'x'), '[\p{{Cc}}\p{{Cf}}]', '', 'g')))::BIGINT AS controls, (length(t) - length(regexp_replace(t, '[^\x00-\x7f]', '', 'g')))::DOUBLE / greatest(length(t), 1) AS non_ascii_share FROM j)
SELECT conv_id, turn, mojibake_markers, replacements, controls, non_ascii_share, round(4.0 * mojibake_markers + 4.0 * replacements + 2.0 * controls + (1 - {_CONF('query')}) + (1 - {_CONF('answer')}) + CASE WHEN {_N('query')} <= 1 THEN 0.5 ELSE 0 END + CASE WHEN {_N('answer')} <= 3 THEN 0.5 ELSE 0 END, 9)::DOUBLE AS risk FROM m""")
def surface_risks(spark, d):
    found = T.surface_risk(F.col("query"), F.col("answer"))
    rows = conversation_pairs(spark, d).select("conv_id", "turn", *(c.alias(n) for n, c in found.items()))
    return rows.withColumn("risk", F.round("risk", 9))


@query(f"""WITH {_PAIRS_SQL}, s AS (SELECT conv_id, turn, list_distinct({_content('query')}) AS q, {_SENTENCES.format(c='answer')} AS s FROM pairs),
e AS (SELECT conv_id, turn, q, len(s) AS n, i - 1 AS i, CASE WHEN len(q) > 0 THEN len(list_intersect(q, {_content('s[i]')}))::DOUBLE / len(q) ELSE 0 END AS score FROM s, unnest(range(1, len(s) + 1)) AS r(i)),
b AS (SELECT conv_id, turn, any_value(n) AS n, max(score) AS best, arg_max(i, score) AS place, count(*) FILTER (score = m) AS winners FROM (SELECT *, max(score) OVER (PARTITION BY conv_id, turn) AS m FROM e) GROUP BY conv_id, turn),
f AS (SELECT s.conv_id AS conv_id, s.turn AS turn, coalesce(best, 0)::DOUBLE AS confidence, best >= 0.2 AND winners = 1 AS clear, place, n FROM s LEFT JOIN b USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN clear THEN place END::INT AS sentence, CASE WHEN clear THEN CASE WHEN n = 1 THEN 'middle' ELSE ['beginning', 'middle', 'end'][round_even(place * 2.0 / (n - 1), 0)::INT + 1] END END AS bucket, confidence FROM f""")
def lexical_focus(spark, d):
    return conversation_pairs(spark, d).select("conv_id", "turn", L.lexical_focus(F.col("query"), F.col("answer")).alias("f")).select("conv_id", "turn", "f.*")


@query("""WITH g AS (SELECT l_orderkey AS id, list((l_extendedprice::DOUBLE) ORDER BY l_linenumber, l_extendedprice) AS s FROM lineitem GROUP BY 1),
e AS (SELECT id, len(s) AS n, i - 1 AS i, s[i] AS score FROM g, unnest(range(1, len(s) + 1)) AS r(i)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS k, lead(score) OVER (PARTITION BY id ORDER BY score DESC, i) AS after FROM e)
SELECT id, i::INT AS sentence, score, CASE WHEN n > 1 THEN score - after ELSE 'inf'::DOUBLE END AS margin, CASE WHEN (i + 0.5) / n <= 1 / 3 THEN 'beginning' WHEN (i + 0.5) / n <= 2 / 3 THEN 'middle' ELSE 'end' END AS bucket, n > 1 AND score - after < 0.1 AS ambiguous, n::INT AS sentences FROM r WHERE k = 1""")
def judge_focus(spark, d):
    """Lines of an order as sentences, prices as their scores."""
    last = lambda c: F.col(c).isNull().alias(f"no_{c}")
    scores = F.transform(F.array_sort(F.collect_list(F.struct(last("l_linenumber"), "l_linenumber", last("l_extendedprice"), F.col("l_extendedprice").cast("double").alias("s")))), lambda x: x["s"])
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(scores.alias("s")).select("id", L.judge_focus(F.col("s")).alias("f")).select("id", "f.*")


#: Runs in SQL: equal tokens of both on one diagonal, numbered, so that neighbours have one number.
_OVERLAP_SQL = f"""WITH {_PAIRS_SQL}, t AS (SELECT conv_id, turn, {_tokens('query')} AS q, {_tokens('answer')} AS p, list_distinct({_content('query')}) AS a, list_distinct({_content('answer')}) AS b FROM pairs),
qi AS (SELECT conv_id, turn, i, q[i] AS w FROM t, unnest(range(1, len(q) + 1)) AS r(i)), pj AS (SELECT conv_id, turn, j, p[j] AS w FROM t, unnest(range(1, len(p) + 1)) AS r(j)),
meet AS (SELECT conv_id, turn, i - j AS diagonal, i, i - row_number() OVER (PARTITION BY conv_id, turn, i - j ORDER BY i) AS island FROM qi JOIN pj USING (conv_id, turn, w)),
runs AS (SELECT conv_id, turn, max(c)::INT AS longest FROM (SELECT conv_id, turn, count(*) AS c FROM meet GROUP BY conv_id, turn, diagonal, island) GROUP BY conv_id, turn),
nums AS (SELECT *, list_distinct(list_filter(q, lambda x: regexp_matches(x, '{T.NUMBER}'))) AS qn, list_distinct(list_filter(p, lambda x: regexp_matches(x, '{T.NUMBER}'))) AS pn, list_distinct(list_filter(q, lambda x: list_contains({_list(T.UNITS)}, x))) AS qu, list_distinct(list_filter(p, lambda x: list_contains({_list(T.UNITS)}, x))) AS pu FROM t),
m AS (SELECT conv_id, turn, {_jaccard('a', 'b', 0.0)} AS content_jaccard, CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) ELSE 0 END AS overlap_coefficient, coalesce(longest, 0) AS longest_copied, CASE WHEN len(q) > 0 THEN coalesce(longest, 0)::DOUBLE / len(q) ELSE 0 END AS copy_density,
    CASE WHEN len(qn) > 0 THEN len(list_intersect(qn, pn))::DOUBLE / len(qn) ELSE 1 END AS number_preservation, CASE WHEN len(qu) > 0 THEN len(list_intersect(qu, pu))::DOUBLE / len(qu) ELSE 1 END AS unit_preservation, len(q)::INT AS word_length, CASE WHEN len(p) > 0 THEN len(q)::DOUBLE / len(p) ELSE 0 END AS length_ratio FROM nums LEFT JOIN runs USING (conv_id, turn))"""
_OVERLAP_COLUMNS = ("content_jaccard", "overlap_coefficient", "longest_copied", "copy_density", "number_preservation", "unit_preservation", "word_length", "length_ratio")


@query(f"{_OVERLAP_SQL} SELECT * FROM m")
def overlap_measures(spark, d):
    return X.overlap_measures(conversation_pairs(spark, d), "query", "answer").select("conv_id", "turn", *_OVERLAP_COLUMNS)


@query()
def copy_risks(spark, d):
    """With the longest common subsequence, which the tests compute by the textbook table."""
    return X.overlap_measures(conversation_pairs(spark, d), "query", "answer").select("conv_id", "turn", "lcs_share", X.copy_risk().alias("risk"))


@query(f"{_OVERLAP_SQL}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM m) WHERE k = 1) SELECT round(quantile_cont(copy_density, 0.95), 9) AS density, round(quantile_cont(longest_copied, 0.95), 9)::DOUBLE AS ngram, round(quantile_cont(length_ratio, 0.99), 9) AS length_ratio FROM f")
def natural_limits(spark, d):
    rows = X.overlap_measures(conversation_pairs(spark, d), "query", "answer")
    return X.natural_limits(rows, "conv_id", "turn").select(*(F.round(c, 9).alias(c) for c in ("density", "ngram", "length_ratio")))


@query(f"""WITH {_PAIRS_SQL}, t AS (SELECT conv_id, turn, list_distinct({_content('query')}) AS a, list_distinct({_content('answer')}) AS b FROM pairs), n AS (SELECT *, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS z FROM t),
r AS (SELECT conv_id, turn, list_filter(a, lambda x: NOT list_contains(b, x)) AS a, list_filter(z, lambda x: NOT list_contains(b, x)) AS z FROM n WHERE z IS NOT NULL) SELECT conv_id, turn, {_jaccard('a', 'z', 1.0)} AS residual FROM r""")
def residual_likeness(spark, d):
    """A question against the conversation's next one, without what the answer holds."""
    from pyspark.sql import Window

    terms = lambda c: F.array_distinct(T.content(T.tokens(F.col(c))))
    rows = conversation_pairs(spark, d).select("conv_id", "turn", terms("query").alias("a"), terms("answer").alias("b"))
    rows = rows.withColumn("z", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("z is not null")
    return rows.select("conv_id", "turn", X.residual_jaccard(F.col("a"), F.col("z"), F.col("b")).alias("residual"))


@query("""WITH v AS (SELECT l_quantity::DOUBLE / 50 AS x, l_orderkey, l_linenumber FROM lineitem) SELECT l_orderkey, l_linenumber, greatest(0, least(1, least(x / 0.2, (1 - x) / (1 - 0.7))))::DOUBLE AS reward FROM v""")
def band_rewards(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", L.overlap_band_reward(F.col("l_quantity").cast("double") / 50, 0.2, 0.7).alias("reward"))


@query("""SELECT o_orderkey, (SELECT count(*) FROM customer WHERE c_acctbal::DOUBLE <= o_totalprice::DOUBLE / 30)::DOUBLE / (SELECT count(c_acctbal) FROM customer) AS percentile FROM orders""")
def margin_percentiles(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 30).alias("v"))
    return X.right_percentile(rows, "v", table(spark, d, "customer").select(F.col("c_acctbal").cast("double").alias("r")), "r").select("o_orderkey", "percentile")


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"""WITH v AS (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in _NUMERIC)} FROM lineitem), p AS (SELECT unnest([{', '.join(f"{{'left': '{a}', 'right': '{b}', 'r': corr({a}, {b})}}" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1:])}]) AS p FROM v)
SELECT p."left" AS "left", p."right" AS "right", round(p.r, 9) AS r, (p."left" = 'l_extendedprice' OR p."right" = 'l_extendedprice') AND abs(p.r) >= 0.9 AS dominates FROM p""")
def reward_correlations(spark, d):
    rows = table(spark, d, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in _NUMERIC))
    return X.correlations(rows, _NUMERIC, "l_extendedprice", 0.9).withColumn("r", F.round("r", 9))


@query("""WITH c AS (SELECT lang, count(*) AS c FROM documents GROUP BY 1), r AS (SELECT lang, c, sum(c) OVER ()::DOUBLE / (count(*) OVER () * c) AS raw FROM c) SELECT lang, c AS n, 1 AS ok FROM r""")
def language_weights(spark, d):
    """Weights stay within bounds and have mean 1; ok tells both, for the weights themselves come from halving."""
    rows = X.balanced_weights(table(spark, d, "documents").select("doc_id", "lang"), "lang")
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.sum("weight").alias("s"))
    whole = rows.agg(F.abs(F.avg("weight") - 1).alias("off"))
    return per.join(F.broadcast(whole)).select("lang", "n", ((F.col("lo") == F.col("hi")) & F.col("lo").between(0.5, 2.0) & (F.col("off") < 1e-9)).cast("int").alias("ok"))


@query("""SELECT page_id, CASE WHEN length(html) <= 2000 THEN '0-2000' WHEN length(html) <= 8000 THEN '2000-8000' WHEN length(html) <= 20000 THEN '8000-20000' ELSE '>20000' END AS bin FROM pages""")
def page_bins(spark, d):
    return table(spark, d, "pages").select("page_id", L.binned(F.length("html"), (2000, 8000, 20000)).alias("bin"))


@query(f"""WITH {_PAIRS_SQL}, c AS (SELECT conv_id, turn, list_distinct({_content('answer')}) AS terms, {_content('query')} AS q FROM pairs) SELECT conv_id, turn, len(list_filter(terms, lambda t: list_contains(q, t)))::BIGINT AS covered, len(terms)::BIGINT AS n FROM c""")
def concept_coverage(spark, d):
    """Single terms of the answer as concepts."""
    rows = conversation_pairs(spark, d).select("conv_id", "turn", F.array_distinct(T.content(T.tokens(F.col("answer")))).alias("terms"), T.content(T.tokens(F.col("query"))).alias("q"))
    hit = L.covered(F.transform("terms", lambda t: F.array(t)), F.col("q"))
    return rows.select("conv_id", "turn", F.size(F.filter(hit, lambda x: x)).cast("long").alias("covered"), F.size("terms").cast("long").alias("n"))


#: Conversations as records with ten items of the benchmark as negatives, most of them damaged in one of fifteen ways.
_DAMAGED_SQL = rf"""{_RECORDS_SQL}, ten AS (SELECT list({{'doc_id': 'b' || item_id, 'text': text}} ORDER BY item_id) AS negs FROM (SELECT item_id, text FROM benchmark WHERE item_id IS NOT NULL ORDER BY item_id LIMIT 10)),
whole AS (SELECT example_id::BIGINT AS n, example_id::BIGINT % 16 AS kind, example_id, query, positives, negs, positives[1].text AS first FROM recs, ten),
hurt AS (SELECT n, CASE WHEN kind = 1 THEN ' ' WHEN n % 32 = 16 THEN (n - 16)::VARCHAR ELSE example_id END AS example_id, CASE kind WHEN 2 THEN ' ' || chr(9) WHEN 14 THEN query || ' Ã³' WHEN 15 THEN first ELSE query END AS query,
    CASE kind WHEN 3 THEN NULL WHEN 4 THEN list_append(positives, {{'doc_id': 'x', 'text': NULL::VARCHAR}}) WHEN 5 THEN positives[1:0] WHEN 8 THEN list_append(positives, negs[3]) ELSE positives END AS positives,
    CASE WHEN kind = 6 THEN negs[1:9] WHEN kind = 7 THEN list_append(negs, negs[1]) WHEN kind BETWEEN 9 AND 13 THEN list_append(negs, {{'doc_id': 'x', 'text': CASE kind WHEN 9 THEN '  ' || first WHEN 10 THEN ' ' WHEN 11 THEN first || chr(7) WHEN 12 THEN first || ' &lt;div>' ELSE first || ' Polityka prywatności' END}}) ELSE negs END AS hard_negatives,
    CASE WHEN kind = 15 THEN 'pl' ELSE 'xx' END AS language FROM whole),
docs AS (SELECT *, list_concat(coalesce(positives, []), hard_negatives) AS docs, positives IS NULL OR len(list_filter(list_concat(positives, hard_negatives), lambda p: p.doc_id IS NULL OR trim(p.doc_id) = '' OR p.text IS NULL)) > 0 AS invalid, row_number() OVER (PARTITION BY example_id ORDER BY n) > 1 AS later FROM hurt)"""
_FLAGS = ("empty_document", "short_text", "long_text", "control_characters", "html", "boilerplate", "possible_mojibake")
_DAMAGE_RULES = {
    "missing_id": "trim(coalesce(example_id, '')) = ''", "empty_query": _EARLY["empty_query"], "invalid_documents": "invalid", "too_few_positives": "NOT invalid AND len(positives) < 1", "too_few_negatives": "NOT invalid AND len(hard_negatives) < 10",
    "duplicate_doc_id": "NOT invalid AND len(docs) > len(list_distinct(list_transform(docs, lambda p: p.doc_id)))", "positive_negative_overlap": "NOT invalid AND list_has_any(list_transform(positives, lambda p: p.doc_id), list_transform(hard_negatives, lambda p: p.doc_id))",
    "same_text_different_ids": f"NOT invalid AND len(list_distinct(list_transform(docs, lambda p: {{'f': {_FORM.format(c='p.text')}, 'i': p.doc_id}}))) > len(list_distinct(list_transform(docs, lambda p: {_FORM.format(c='p.text')})))",
    "high_query_passage_overlap": f"NOT invalid AND ({_LATE['high_query_passage_overlap']})", "likely_non_polish": f"NOT invalid AND language = 'pl' AND {_LATE['likely_non_polish']}", "duplicate_example_id": "later",
    **{rule: f"NOT invalid AND ({_LATE[rule].replace('list_filter(positives', 'list_filter(docs')})" for rule in _FLAGS},
}
_DAMAGE_SQL = f"{_DAMAGED_SQL}, found AS (SELECT n, list_sort(list_filter([{', '.join(f'CASE WHEN {t} THEN {chr(39)}{r}{chr(39)} END' for r, t in _DAMAGE_RULES.items())}], lambda x: x IS NOT NULL)) AS issues FROM docs)"


def damaged_records(spark, d):
    doc = "struct<doc_id:string,text:string>"
    ten = table(spark, d, "benchmark").where("item_id is not null").orderBy("item_id").limit(10).select("item_id", F.struct(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("doc_id"), "text").alias("d"))
    negatives = F.broadcast(ten.agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "d"))), lambda x: x["d"]).alias("negs")))  # ten items
    rows = conversation_records(spark, d).drop("hard_negatives", "language").join(negatives).withColumn("n", F.col("example_id").cast("long")).withColumn("kind", F.col("n") % 16).withColumn("first", F.get("positives", 0)["text"])
    kind, with_ = F.col("kind"), lambda docs, i, t: F.array_append(docs, F.struct(F.lit(i).alias("doc_id"), t.alias("text")).cast(doc))
    other = {9: F.concat(F.lit("  "), "first"), 10: F.lit(" "), 11: F.concat("first", F.lit("\x07")), 12: F.concat("first", F.lit(" &lt;div>")), 13: F.concat("first", F.lit(" Polityka prywatności"))}
    negs = F.when(kind == 6, F.slice("negs", 1, 9)).when(kind == 7, F.array_append("negs", F.get("negs", 0)))
    for k, text in other.items():
        negs = negs.when(kind == k, with_(F.col("negs"), "x", text))
    return rows.select(
        "n", F.when(kind == 1, " ").when(F.col("n") % 32 == 16, (F.col("n") - 16).cast("string")).otherwise(F.col("example_id")).alias("example_id"),
        F.when(kind == 2, " \t").when(kind == 14, F.concat("query", F.lit(" Ã³"))).when(kind == 15, F.col("first")).otherwise(F.col("query")).alias("query"),
        F.when(kind == 3, F.lit(None)).when(kind == 4, with_(F.col("positives"), "x", F.lit(None).cast("string"))).when(kind == 5, F.slice("positives", 1, 0)).when(kind == 8, F.array_append("positives", F.get("negs", 2))).otherwise(F.col("positives")).alias("positives"),
        negs.otherwise(F.col("negs")).alias("hard_negatives"), F.when(kind == 15, "pl").otherwise("xx").alias("language"),
    )


@query(f"WITH {_DAMAGE_SQL} SELECT n, array_to_string(issues, ',') AS issues, CASE WHEN list_has_any(issues, {_list(validation.MODES)}) THEN 'rejected' ELSE 'accepted' END AS route FROM found")
def broken_records(spark, d):
    """Every rule of the validator on damaged conversations."""
    return validation.routed(damaged_records(spark, d), ordinal="n").select("n", F.array_join("issues", ",").alias("issues"), "route")


@query(f"WITH {_DAMAGE_SQL}, e AS (SELECT n, CASE WHEN list_contains({_list(validation.MODES)}, r) THEN 'drop' ELSE 'warn' END AS mode FROM (SELECT n, unnest(issues) AS r FROM found)) SELECT mode, count(DISTINCT n) AS records, count(*) AS issues FROM e GROUP BY mode")
def broken_modes(spark, d):
    return validation.mode_counts(validation.routed(damaged_records(spark, d), ordinal="n").withColumn("example_id", F.col("n").cast("string")))


#: A turn's first three words as a completion in one of seven shapes; what must come of each.


@query(f"""WITH w AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 7 AS kind, len({_words('text')}) AS n FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN kind IN (0, 1, 2) AND n > 0 THEN least(n, 3)::INT END AS n, kind IN (0, 1, 2) AND n > 0 AS valid, kind IN (1, 2) AS repaired FROM w""")
def parsed_outputs(spark, d):
    """Completions made of turns: plain, fenced, with a comma too many, and broken ones."""
    t = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", ((F.col("conv_id") * 7 + F.col("turn")) % 7).alias("kind"), F.slice(T.words(F.col("text")), 1, 3).alias("w"))
    body = F.concat(F.lit('{"queries":'), F.to_json(F.transform("w", lambda x: F.struct(x.alias("text")))))
    shapes = [F.concat(body, F.lit("}")), F.concat(F.lit("```json\n"), body, F.lit("}\n```")), F.concat(body, F.lit(",}")), F.lit('{"queries":[]}'), F.lit('{"queries":[{"text":" "}]}'), F.array_join("w", " "), F.lit("")]
    found = T.parsed_queries(F.element_at(F.array(*shapes), (F.col("kind") + 1).cast("int")))
    return t.select("conv_id", "turn", F.when(found["valid"], F.size(found["queries"])).alias("n"), found["valid"].alias("valid"), found["repaired"].alias("repaired"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'uncertain' END AS verdict FROM labels WHERE doc_id IS NOT NULL")
def parsed_verdicts(spark, d):
    shapes = ['{"verdict":" YES "}', '{"verdict":"no","x":1}', '{"reason":"r","verdict":"Uncertain"}', '{"verdict":"maybe"}', "yes"]
    raw = F.element_at(F.array(*map(F.lit, shapes)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "labels").where("doc_id is not null").select("doc_id", T.parsed_verdict(raw).alias("verdict"))


@query(f"""WITH {_PAIRS_SQL}, t AS (SELECT conv_id, turn, {_tokens('query')} AS q FROM pairs)
SELECT conv_id, turn, ({' + '.join(f"(SELECT count(DISTINCT array_to_string(q[i:i+{k - 1}], ' ')) FROM unnest(range(1, len(q) - {k - 2})) AS r(i))" for k in range(1, 5))})::BIGINT AS n FROM t""")
def gram_counts(spark, d):
    return conversation_pairs(spark, d).select("conv_id", "turn", F.size(T.ngrams(T.tokens(F.col("query")))).cast("long").alias("n"))


@query(f"""WITH {_PAIRS_SQL}, s AS (SELECT conv_id, turn, trim(coalesce(query, '')) AS bare, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS line, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS passage, regexp_matches(trim(query, ' ' || chr(9) || chr(10) || chr(13)), '[\\n\\r]') AS several FROM pairs),
r AS (SELECT conv_id, turn, CASE WHEN bare = '' THEN 'empty' WHEN several THEN 'several_lines' WHEN len({_words('line')}) < 2 THEN 'too_short' WHEN contains(passage, line) THEN 'copied' END AS reason FROM s) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def training_rows(spark, d):
    rows = records.completions(conversation_pairs(spark, d), "query", "answer", records.prompt(F.col("answer"), {"forma": F.lit("dowolna")}))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, -0.1::DOUBLE * ((-l_quantity::DOUBLE - -l_extendedprice::DOUBLE / 1000) - (-l_discount::DOUBLE * 100 - -l_tax::DOUBLE * 100)) AS x FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 9) AS loss FROM x""")
def preference_losses(spark, d):
    """Prices as made-up log-probabilities."""
    n = lambda c, f=1.0: -F.col(c).cast("double") * f
    loss = X.preference_loss(n("l_quantity"), -F.col("l_extendedprice").cast("double") / 1000, n("l_discount", 100), n("l_tax", 100), 0.1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(loss, 9).alias("loss"))


@query("""WITH o AS (SELECT l_orderkey, coalesce(avg(l_quantity::DOUBLE) FILTER (l_returnflag <> 'N'), 0) AS m FROM lineitem WHERE l_orderkey IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1), j AS (SELECT o_orderpriority, m, coalesce(o_totalprice::DOUBLE / 1000, 0) AS w FROM o JOIN orders ON o_orderkey = l_orderkey)
SELECT o_orderpriority, count(*) AS examples, round(sum(w), 6) AS weight, round(sum(m * w) / greatest(sum(w), 1e-6), 9) AS loss FROM j GROUP BY 1""")
def weighted_losses(spark, d):
    """Quantities of an order's lines as token losses, of which returned and accepted ones count, weighted by the order's price."""
    lines = table(spark, d, "lineitem").where("l_orderkey is not null and l_quantity is not null").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("double").alias("l"), (F.col("l_returnflag") != "N").alias("m"))).alias("t"))
    rows = lines.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderpriority", F.col("t.l").alias("losses"), F.col("t.m").alias("mask"), (F.col("o_totalprice").cast("double") / 1000).alias("w"))
    found = X.weighted_loss(rows, "losses", "mask", "w", ["o_orderpriority"])
    return found.select("o_orderpriority", "examples", F.round("weight", 6).alias("weight"), F.round("loss", 9).alias("loss"))


@query(f"""WITH {_PAIRS_SQL} SELECT conv_id, turn, replace(lower(query), 'ß', 'ss') AS folded, CASE WHEN length(answer) < 64 THEN 'short' WHEN length(answer) < 192 THEN 'medium' ELSE 'long' END AS size, round(length(query) / 100.0::DOUBLE + 0.5 * turn, 9) AS reward FROM pairs""")
def folded_queries(spark, d):
    """Folded queries, the size class of their answers, and a reward made of both lengths."""
    reward = X.grounding_reward(F.length("query") / 100.0, F.col("turn"))
    return conversation_pairs(spark, d).select("conv_id", "turn", T.folded(F.col("query")).alias("folded"), L.length_bucket(F.length("answer")).alias("size"), F.round(reward, 9).alias("reward"))


@query(f"""WITH {_PAIRS_SQL}, c AS (SELECT conv_id, turn, unnest({_content('answer')}) AS t FROM pairs), n AS (SELECT conv_id, turn, t, count(*) AS n FROM c WHERE NOT list_contains({_list(T.UNITS)}, t) AND NOT regexp_matches(t, '{T.NUMBER}') GROUP BY ALL), o AS (SELECT conv_id, turn, t, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, t) AS i FROM n),
g AS (SELECT conv_id, turn, list(t ORDER BY i) AS ts FROM o WHERE i <= 8 GROUP BY ALL) SELECT p.conv_id AS conv_id, p.turn AS turn, coalesce(array_to_string(ts, ' '), '') AS concepts FROM pairs p LEFT JOIN g ON g.conv_id = p.conv_id AND g.turn = p.turn""")
def answer_concepts(spark, d):
    """The terms an answer is about, without numbers and units: these come first and are tested on their own."""
    rows = conversation_pairs(spark, d).select("conv_id", "turn", T.content(T.tokens(F.col("answer"))).alias("t"))
    return rows.select("conv_id", "turn", F.array_join(L.concepts(F.filter("t", lambda x: ~x.isin(*T.UNITS) & ~x.rlike(T.NUMBER)), F.array().cast("array<string>"), 8), " ").alias("concepts"))


@query(f"""WITH {_DAMAGED_SQL}, i AS (SELECT n, list_transform(coalesce(positives, []), lambda p: p.doc_id) AS a, list_transform(hard_negatives, lambda p: p.doc_id) AS b FROM hurt)
SELECT n, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: len(list_filter(b, lambda y: y = x)) > 1))), ',') AS repeated, array_to_string(list_sort(list_intersect(a, b)), ',') AS shared FROM i""")
def id_faults(spark, d):
    """Ids that stand twice among the negatives, and ids on both sides, of damaged conversations."""
    rows = damaged_records(spark, d).withColumn("positives", F.coalesce("positives", F.slice("hard_negatives", 1, 0)))
    return rows.select("n", F.array_join(records.repeated_ids(F.col("hard_negatives")), ",").alias("repeated"), F.array_join(records.shared_ids(F.col("positives"), F.col("hard_negatives")), ",").alias("shared"))


@query(f"""WITH {_DAMAGED_SQL}, e AS (SELECT unnest(list_concat(positives, hard_negatives)) AS p FROM hurt WHERE positives IS NOT NULL) SELECT p.doc_id AS doc_id, md5(coalesce(min(p.text), '')) AS text, count(DISTINCT p.text) AS n_texts FROM e GROUP BY 1""")
def union_documents(spark, d):
    """All documents of damaged records, once each; an id with several texts is a conflict."""
    found = records.document_union(damaged_records(spark, d).where("positives is not null"))
    return found.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text"), "n_texts")


@query(f"""WITH {_DAMAGED_SQL}, e AS (SELECT n, query, hard_negatives, generate_subscripts(positives, 1) - 1 AS i, unnest(positives) AS p FROM hurt WHERE positives IS NOT NULL) SELECT n, i::INT AS positive_index, p.doc_id AS doc_id, len(hard_negatives)::INT AS negatives FROM e""")
def group_expansion(spark, d):
    """A scoring group for each positive of a record, with all its negatives."""
    rows = damaged_records(spark, d).where("positives is not null").withColumn("example_id", F.col("n"))
    return records.scoring_groups(rows).select(F.col("example_id").alias("n"), "positive_index", F.col("positive.doc_id").alias("doc_id"), F.size("negatives").alias("negatives"))


@query(f"""WITH {_DAMAGED_SQL} SELECT n, list_sort(list_transform(positives, lambda p: p.doc_id))[1] AS doc_id FROM hurt WHERE positives IS NOT NULL""")
def first_sources(spark, d):
    """The first positive of each record by id, as what is generated from."""
    rows = damaged_records(spark, d).where("positives is not null").withColumn("example_id", F.col("n"))
    return records.generator_sources(rows).select(F.col("example_id").alias("n"), "doc_id")


@query("""WITH r AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 23.5) AS kept, count(*) FILTER (l_quantity <= 23.5) AS dropped FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1) SELECT l_orderkey, kept, kept >= 1 AND dropped >= 2 AS usable FROM r""")
def strict_scores(spark, d):
    """Lines as scored documents: strictly better ones count, and an order is usable with one of them and two others."""
    doc = F.struct(F.col("l_linenumber").cast("string").alias("doc_id"), F.col("l_quantity").cast("double").alias("score"))
    rows = table(spark, d, "lineitem").where("l_orderkey is not null").groupBy("l_orderkey").agg(F.collect_list(doc).alias("docs"))
    kept = records.score_filter(F.col("docs"), 23.5, strict=True)
    low = F.filter("docs", lambda x: x["score"] <= 23.5)
    return rows.select("l_orderkey", F.size(kept).cast("long").alias("kept"), ((F.size(kept) >= 1) & (F.size(low) >= 2)).alias("usable"))
