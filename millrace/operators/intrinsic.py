"""One row of measures for each generated query, their summary by mode and by slice, gates over two arms, slot predictions, and the
plan of blind double reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import lexical as X
from ..functions import text as T
from .pairs import self_bleu
from .retrieval import pool_metrics
from .statistics import compare_all_arms, distribution

#: Columns that a row may lack; they then count as null.
OPTIONAL = {"shadow_positive": "double", "shadow_negatives": "array<double>", "requested_form": "string", "requested_intent": "string", "requested_focus": "string", "corpus_rank": "long", "mode": "string"}
#: Ranks up to which a passage counts as found again.
ROUND_TRIPS = (1, 5, 20, 100)
from .tables import ranked, written


def intrinsic_rows(rows: DataFrame, cutoffs: Sequence[int] = ROUND_TRIPS) -> DataFrame:
    """rows(id, group, query, passage, reference, positive, negatives, and any of OPTIONAL) with their measures: pool_* of the positive's
    score against the negatives', shadow_pool_* of a second judge and judge_rank_disagreement, round_trip_at_k, what query and
    passage have in common, the reference's content_jaccard as natural_content_jaccard, the form's flags, the focus sentence and
    bucket, focus_accuracy, reference_focus_agreement, style, form and intent with confidences and accuracies. A measure whose
    input isn't there is null. Rows don't need one another: only narrow columns are added, nothing is shuffled."""
    full = rows.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in rows.columns})
    out = X.overlap_measures(full, "query", "passage")
    natural = T.jaccard(F.array_distinct(T.content(T.tokens(F.coalesce("reference", F.lit(""))))), F.array_distinct(T.content(T.tokens(F.col("passage")))))
    shadow = pool_metrics(F.col("shadow_positive"), F.col("shadow_negatives"))
    has_shadow = F.col("shadow_positive").isNotNull() & F.col("shadow_negatives").isNotNull()
    labels, form = L.query_labels(F.col("query")), L.format_metrics(F.col("query"))
    focus, own = L.lexical_focus(F.col("query"), F.col("passage")), L.lexical_focus(F.coalesce("reference", F.lit("")), F.col("passage"))
    out = out.withColumns({
        **pool_metrics(F.col("positive"), F.col("negatives")), **{f"shadow_{n}": F.when(has_shadow, c) for n, c in shadow.items()}, "natural_content_jaccard": natural, "__focus": focus, "__own": own,
        **{n: c for n, c in form.items() if n != "word_length"}, "predicted_style": L.query_style(F.col("query")), **{f"predicted_{n}": labels[n] for n in ("form", "intent")}, **{n: labels[n] for n in ("form_confidence", "intent_confidence")},
        **{f"round_trip_at_{k}": F.when(F.col("corpus_rank").isNotNull(), (F.col("corpus_rank") <= k).cast("double")) for k in cutoffs},
    })
    asked = lambda wanted, got: F.when(F.col(wanted).isNotNull(), F.coalesce((F.col(wanted) == F.col(got)).cast("double"), F.lit(0.0)))
    out = out.withColumns({"predicted_sentence": F.col("__focus.sentence"), "predicted_focus": F.col("__focus.bucket"), "reference_focus": F.col("__own.bucket"), "reference_sentence": F.col("__own.sentence")}).drop("__focus", "__own")
    return out.withColumns({
        "judge_rank_disagreement": F.when(has_shadow, F.col("pool_rank") != F.col("shadow_pool_rank")), "focus_accuracy": asked("requested_focus", "predicted_focus"),
        "reference_focus_agreement": F.col("predicted_sentence").eqNullSafe(F.col("reference_sentence")).cast("double"), "form_accuracy": asked("requested_form", "predicted_form"),
        "intent_accuracy": F.when(F.col("predicted_intent") != "unknown", asked("requested_intent", "predicted_intent")), "form_abstained": F.col("predicted_form") == "unknown", "intent_abstained": F.col("predicted_intent") == "unknown",
    })


#: What a summary tells of each mode: distributions of these, and rates of those.
SPREAD = ("pool_candidate_count", "pool_margin", "content_jaccard", "query_precision", "passage_recall", "longest_copied", "lcs_share", "copy_density", "number_preservation", "unit_preservation", "word_length")
RATES = ("pool_mrr", "pool_ndcg_at_10", "pool_recall_at_1", "pool_recall_at_5", "round_trip_at_1", "round_trip_at_5", "round_trip_at_20", "round_trip_at_100", "empty", "multiple_query", "has_prefix", "has_metacomment", "format_valid", "focus_accuracy", "reference_focus_agreement", "judge_rank_disagreement")


def _long(rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(by..., metric, value): a row for each metric that a row has."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return rows.select(*by, each.alias("x")).select(*by, "x.*").where("value is not null and not isnan(value)")


def mode_summaries(measured: DataFrame, mode: str = "mode", spread: Sequence[str] = SPREAD, rates: Sequence[str] = RATES) -> DataFrame:
    """measured (of intrinsic_rows) -> (mode, metric, n, mean, least, p05, p25, p50, p75, p95, most): the distribution of each measure of
    `spread`, and n and mean alone of those of `rates`, over the rows that have it; a null mode is 'unknown'. Rates combine before
    the shuffle; a distribution's values meet by mode and metric."""
    known = measured.withColumn("mode", F.coalesce(F.col(mode), F.lit("unknown")))
    whole = _long(known, ["mode"], spread).groupBy("mode", "metric").agg(*distribution("value"))
    means = _long(known, ["mode"], rates).groupBy("mode", "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return whole.unionByName(means, allowMissingColumns=True)


def focus_summary(measured: DataFrame, mode: str = "mode") -> DataFrame:
    """(mode, n, first_sentence_share, bucket_entropy, sentence_gini, buckets: counts by name): where in their passages a mode's queries
    aim; rows without a focus count as bucket `none`."""
    rows = measured.select(F.coalesce(F.col(mode), F.lit("unknown")).alias("mode"), F.coalesce("predicted_focus", F.lit("none")).alias("bucket"), "predicted_sentence")
    buckets = rows.groupBy("mode", "bucket").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("predicted_sentence") == 0).alias("f"))
    places = rows.where("predicted_sentence is not null").groupBy("mode", "predicted_sentence").agg(F.count(F.lit(1)).alias("c")).groupBy("mode").agg(F.array_sort(F.collect_list("c")).alias("cs"))  # a number for each sentence place
    total = F.aggregate("cs", F.lit(0).cast("long"), lambda s, x: s + x)
    weighted = F.aggregate(F.transform("cs", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    gini = places.select("mode", (2 * weighted / (F.size("cs") * total) - (F.size("cs") + 1) / F.size("cs")).alias("sentence_gini"))
    n = F.sum("c")
    found = buckets.groupBy("mode").agg(n.alias("n"), (F.sum("f") / n).alias("first_sentence_share"), (F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("bucket_entropy"), F.array_sort(F.collect_list(F.struct("bucket", "c"))).alias("buckets"))
    return found.join(gini, "mode", "left").select("mode", "n", "first_sentence_share", "bucket_entropy", "sentence_gini", "buckets")


def _bits(values: Column) -> Column:
    """Shannon's entropy of an array of labels, in bits; null where it is empty."""
    share = lambda v: F.size(F.filter(values, lambda x: x.eqNullSafe(v))) / F.size(values)
    return F.when(F.size(values) > 0, F.aggregate(F.array_distinct(values), F.lit(0.0), lambda s, v: s - share(v) * F.log2(share(v))))


def group_measures(measured: DataFrame, by: Sequence[str] = ("group", "mode")) -> DataFrame:
    """measured(by..., id, query, predicted_style, predicted_focus) -> (by..., n, distinct_1, distinct_2, self_bleu, mean_jaccard, max_jaccard,
    duplicate_rate, style_entropy, focus_entropy) of groups of a few candidates; they are listed by id."""
    one = F.struct(F.col("id"), T.tokens(F.coalesce("query", F.lit(""))).alias("tokens"), F.lower(F.btrim("query")).alias("form"), F.col("predicted_style").alias("style"), F.col("predicted_focus").alias("focus"))
    g = measured.groupBy(*by).agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("rows"))
    tokens, terms = F.transform("rows", lambda r: r["tokens"]), F.transform("rows", lambda r: F.array_distinct(T.content(r["tokens"])))
    two = lambda t: F.array_distinct(F.when(F.size(t) >= 2, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.array_join(F.slice(t, i, 2), " "))).otherwise(F.array().cast("array<string>")))
    pairs = T.bound(terms, lambda ts: F.flatten(F.transform(ts, lambda a, i: F.transform(F.slice(ts, i + 2, F.size(ts)), lambda b: T.jaccard(a, b, 1.0)))))
    g = g.withColumns({"__one": F.flatten(tokens), "__two": F.flatten(F.transform(tokens, two)), "__pairs": pairs})
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    return g.select(
        *by, F.size("rows").alias("n"), T.share(F.array_distinct("__one"), F.col("__one"), None).alias("distinct_1"), T.share(F.array_distinct("__two"), F.col("__two"), None).alias("distinct_2"), self_bleu(tokens).alias("self_bleu"), mean("__pairs").alias("mean_jaccard"),
        F.array_max("__pairs").alias("max_jaccard"), (1 - F.size(F.array_distinct(F.transform("rows", lambda r: r["form"]))) / F.size("rows")).alias("duplicate_rate"), _bits(F.transform("rows", lambda r: r["style"])).alias("style_entropy"), _bits(F.transform("rows", lambda r: r["focus"])).alias("focus_entropy"),
    )


def slice_distributions(rows: DataFrame, slices: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(field, value, count, metric, n, mean, least, p05, ..., most): for each value of each slice field, null as 'unknown', its rows and the
    distribution of each metric over those that have it; n is 0 where none has. Counts of a field add up to all rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("field"), F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias("value")) for s in slices)))
    number = lambda m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias(m)
    each = rows.select(pairs.alias("s"), *map(number, metrics)).select("s", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))).alias("x"))
    return each.select("s.*", "x.*").groupBy("field", "value", "metric").agg(F.count(F.lit(1)).alias("count"), *distribution("v"))


def quality_gate(baseline: DataFrame, variant: DataFrame, natural_rate: float, group: str, id_col: str, risk: str, semantic: tuple[str, str], limits: dict[str, float], samples: int = 200) -> DataFrame:
    """baseline, variant(group, id, risk boolean, and the two semantic measures of a group: clusters, greatest cosine) -> (guardrail, status,
    value, bound): natural tails of both arms (risk rate at most natural_rate + limits['tail']), variant against baseline (upper bound
    of the difference of risk at most limits['risk']), common clean groups (their share at least limits['clean']), clusters (lower
    bound of the difference over them at least -limits['clusters']), cosine (upper bound at most limits['cosine']), and `decision`:
    continue if all passed, else stop. Arms must have the same ids in the same groups; else it is an error. Both arms' rows move once by
    id and group, all else goes by one row a group, and a group's draws are made once for all measures."""
    clusters, cosine = semantic
    number = lambda c, arm: F.max(F.when(F.col("arm") == arm, F.col(c)))
    total = lambda c, arm: F.sum(F.when(F.col("arm") == arm, F.col(c)).otherwise(0))
    rows = lambda df, arm: df.select(F.lit(arm).alias("arm"), F.col(group).alias("g"), F.col(id_col).cast("string").alias("i"), F.lit(1).alias("n"), F.coalesce(F.col(risk), F.lit(True)).cast("int").alias("r"), F.col(clusters).cast("double").alias("clusters"), F.col(cosine).cast("double").alias("cosine"))
    fields = [(c, f, k) for c, f in (("n", total), ("r", total), ("clusters", number), ("cosine", number)) for k in (0, 1)]
    ids = rows(baseline, 0).unionAll(rows(variant, 1)).groupBy("g", "i").agg(*(f(c, k).alias(f"{c}{k}") for c, f, k in fields))
    odd = F.struct(F.coalesce("i", F.lit("null")).alias("i"), F.coalesce(F.col("g").cast("string"), F.lit("null")).alias("g"))
    per = written(ids.groupBy("g").agg(*((F.sum if f is total else F.max)(f"{c}{k}").alias(f"{c}{k}") for c, f, k in fields), F.max(F.when(F.col("n0") != F.col("n1"), odd)).alias("odd")), "gate-groups")
    clean = F.col("g").isNotNull() & (F.col("r0") == 0) & (F.col("r1") == 0)
    sums = per.agg(F.max("odd").alias("odd"), F.count(F.lit(1)).alias("n"), F.count_if(clean).alias("clean"), *(F.sum(c).alias(c) for c in ("n0", "n1", "r0", "r1"))).first()
    if sums["odd"]:
        raise ValueError(f"the arms differ in {sums['odd']['i']} of {sums['odd']['g']}")
    rates = {name: sums[f"r{k}"] / sums[f"n{k}"] if sums["n"] else None for k, name in enumerate(("baseline", "variant"))}
    n, n_clean = sums["n"], sums["clean"]
    measures = lambda k: F.struct(F.lit("ab"[k]).alias("arm"), (F.col(f"r{k}") / F.col(f"n{k}")).alias("risk"), *(F.when(clean, F.col(f"{c}{k}")).alias(c) for c in ("clusters", "cosine")))
    arms = per.where("g is not null").select("g", F.explode(F.array(measures(0), measures(1))).alias("x")).select("g", "x.*")
    others = {r["metric"]: r for r in compare_all_arms(arms, "arm", "g", ["risk", "clusters", "cosine"], [("a", "b")], samples).collect()} if n else {}
    risks = others.get("risk")
    bound = lambda m, side: others[m][side] if n_clean and m in others else None
    rate = n_clean / n if n else None
    checks = [
        ("baseline_natural_tail", rates["baseline"], natural_rate + limits["tail"], lambda v, x: v <= x), ("variant_natural_tail", rates["variant"], natural_rate + limits["tail"], lambda v, x: v <= x),
        ("variant_vs_baseline", risks and risks["high"], limits["risk"], lambda v, x: v <= x), ("common_clean_groups", rate, limits["clean"], lambda v, x: v >= x),
        ("clusters", bound("clusters", "low"), -limits["clusters"], lambda v, x: v >= x), ("cosine", bound("cosine", "high"), limits["cosine"], lambda v, x: v <= x),
    ]
    told = [(name, "passed" if v is not None and holds(v, x) else "failed", None if v is None else float(v), float(x)) for name, v, x, holds in checks]
    told.append(("decision", "continue" if all(t[1] == "passed" for t in told) else "stop", None, None))
    return baseline.sparkSession.createDataFrame(told, "guardrail string, status string, value double, bound double")


#: The roles of a group's slots.
SLOTS = {"good": 0, "paraphrase": 1, "near_copy": 2, "general": 3, "ungrounded": 4, "copied": 5, "wrong_focus": 6, "wrong_form": 7}


def slot_predictions(rows: DataFrame, thresholds: dict[str, float], likeness: float = 0.9) -> DataFrame:
    """rows(group, slot, query, copy_density, longest_copied, content_jaccard, entity_preservation, declared_focus, focus, format_valid,
    declared_form, style, eligible boolean, score, shadow_score, round_trip) -> (prediction, hits, ties, n, rate, threshold, passed) over groups with
    each of the eight slots once: P1 the copied slot leads all others in density and run; P2 the general one is below the good one in both
    measures; P3 wrong and good focus; P4 the wrong form is invalid, slots 0, 1 and 3 are valid; P5 these have the declared form; P6 the
    near copy is a duplicate of the good one; P7 the group is eligible; P8a the ungrounded one scores below the good one, P8a_shadow by
    the second judge, P8b the general one is found again less often. Without a threshold, passed is null."""
    fields = [c for c in rows.columns if c not in ("group", "slot")]
    g = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("slot").between(0, 7), F.col("slot"))).alias("k"), F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), F.struct(*fields)))).alias("s")).where("n = 8 and k = 8")
    of = lambda slot, c: F.element_at("s", F.lit(slot))[c]
    good, general, near, ungrounded, copied, focus, form = (SLOTS[k] for k in ("good", "general", "near_copy", "ungrounded", "copied", "wrong_focus", "wrong_form"))
    others = [k for k in range(8) if k != copied]
    leads = lambda c: of(copied, c) > F.greatest(*(of(k, c) for k in others))
    less = lambda a, b, c: of(a, c) < of(b, c)
    terms = lambda k: F.array_distinct(T.content(T.tokens(of(k, "query"))))
    same = (T.normal_form(of(good, "query")) == T.normal_form(of(near, "query"))) | (T.jaccard(terms(good), terms(near), 1.0) >= likeness)
    three, none = (good, SLOTS["paraphrase"], general), F.lit(False)
    tests: list[tuple[str, Column, Column, Column]] = [
        ("P1", F.lit(True), leads("copy_density") & leads("longest_copied"), none), ("P2", F.lit(True), less(general, good, "content_jaccard") & less(general, good, "entity_preservation"), none),
        ("P3_wrong_focus", of(focus, "declared_focus").isNotNull(), ~of(focus, "focus").eqNullSafe(of(focus, "declared_focus")), none), ("P3_good", of(good, "declared_focus").isNotNull(), of(good, "focus").eqNullSafe(of(good, "declared_focus")), none),
        ("P4_wrong_form", F.lit(True), ~of(form, "format_valid"), none), *(("P4_good", F.lit(True), of(k, "format_valid"), none) for k in three), *(("P5", F.lit(True), of(k, "style") == of(k, "declared_form"), none) for k in three),
        ("P6", F.lit(True), same, none), ("P7", F.lit(True), of(good, "eligible"), none), ("P8a", F.lit(True), less(ungrounded, good, "score"), of(ungrounded, "score") == of(good, "score")),
        ("P8a_shadow", F.lit(True), less(ungrounded, good, "shadow_score"), of(ungrounded, "shadow_score") == of(good, "shadow_score")), ("P8b", F.lit(True), less(general, good, "round_trip"), of(general, "round_trip") == of(good, "round_trip")),
    ]
    each = g.select(F.explode(F.array(*(F.struct(F.lit(n).alias("prediction"), counts.alias("counts"), F.coalesce(hit, none).alias("hit"), F.coalesce(tie, none).alias("tie")) for n, counts, hit, tie in tests))).alias("x")).select("x.*").where("counts")
    found = each.groupBy("prediction").agg(F.count_if("hit").alias("hits"), F.count_if("tie").alias("ties"), F.count(F.lit(1)).alias("n"))
    limit = F.lit(None).cast("double")
    for name, x in thresholds.items():
        limit = F.when(F.col("prediction") == name, F.lit(float(x))).otherwise(limit)
    return found.withColumn("rate", F.col("hits") / F.col("n")).withColumn("threshold", limit).withColumn("passed", F.when(F.col("threshold").isNotNull(), F.col("rate") >= F.col("threshold")))


#: What a blind row holds, and nothing else.
BLIND_FIELDS = ("audit_id", "passage", "query_a", "query_b", "orientation_commitment")


def review_plan(blind: DataFrame, models: dict[str, int], size: int, per_pair: int, prompt_version: str, expected: int | None = None) -> DataFrame:
    """blind(BLIND_FIELDS) -> (model, batch, item_ids, max_tokens, request_id): every pair is reviewed by every model, in batches of `size` in
    order of audit_id. models: name -> tokens that a request costs besides `per_pair` for each pair. Another column, which might tell
    what the selection did, a blank field, two equal queries, a repeated id or another number of pairs than `expected` is an error."""
    if sorted(blind.columns) != sorted(BLIND_FIELDS):
        raise ValueError(f"blind pairs hold {sorted(set(blind.columns) ^ set(BLIND_FIELDS))}")
    rows = blind.select(*(F.btrim(F.col(c).cast("string")).alias(c) for c in BLIND_FIELDS))
    blank = F.exists(F.array(*BLIND_FIELDS), lambda x: F.coalesce(x, F.lit("")) == "") | (F.col("query_a") == F.col("query_b"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("audit_id").alias("ids"), F.count_if(blank).alias("bad")).first()
    if found["bad"] or found["ids"] != found["n"] or expected not in (None, found["n"]):
        raise ValueError(f"{found['n']} blind pairs of which {found['ids']} differ in id and {found['bad']} are blank or equal")
    placed = ranked(rows, "audit_id").withColumn("batch", F.floor(F.col("rank") / size))
    content = F.sha2(F.concat_ws("\0", "audit_id", "passage", "query_a", "query_b"), 256)
    batches = placed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("audit_id", content.alias("content")))).alias("items"))
    each = batches.select("batch", "items", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(extra).alias("extra")) for m, extra in models.items()))).alias("m"))
    ids = F.transform("items", lambda x: x["audit_id"])
    identity = F.concat_ws("\0", F.lit(prompt_version), F.col("m.model"), F.array_join(ids, ","), F.array_join(F.transform("items", lambda x: x["content"]), ","))
    return each.select(F.col("m.model").alias("model"), "batch", ids.alias("item_ids"), (F.size("items") * per_pair + F.col("m.extra")).alias("max_tokens"), F.sha2(identity, 256).alias("request_id"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """(model, requests, ratings) of a review plan."""
    return plan.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.size("item_ids")).alias("ratings"))
