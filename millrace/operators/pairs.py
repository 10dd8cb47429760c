"""Same-prompt groups: gates, tentative and defect pairs, verdicts, blind audits and their evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .selection import hash_order


def labels(tests: dict[str, Column]) -> Column:
    """The sorted names of the tests that hold."""
    return F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in tests.items()))))


def self_bleu(token_lists: Column) -> Column:
    """Of an array of token arrays: the mean over its members of the smoothed precision of their 1- to 4-gram sets against those of
    the others, with the brevity penalty against the longest other; null for fewer than two. Groups of a few candidates."""
    grams = lambda t, k: F.array_distinct(F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))).otherwise(F.array().cast("array<string>")))

    def of_size(k: int):
        return lambda t: grams(t, k)

    def of(lists: Column) -> Column:
        def one(t: Column, at: Column) -> Column:
            others = F.filter(lists, lambda _, i: i != at)
            logs = F.lit(0.0)
            for k in (1, 2, 3, 4):
                theirs = F.flatten(F.transform(others, of_size(k)))
                logs = logs + F.log((F.size(F.array_intersect(grams(t, k), theirs)) + 1) / (F.size(grams(t, k)) + 1)) / 4
            longest = F.array_max(F.transform(others, F.size))
            return F.least(F.lit(1.0), F.exp(1 - longest / F.greatest(F.size(t), F.lit(1)))) * F.exp(logs)

        each = F.transform(lists, one)
        return F.when(F.size(lists) >= 2, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(lists))

    return T.bound(token_lists, of)


def diversity_gate(rows: DataFrame, group: str, position: str, text_col: str, prompt: str, size: int = 8, least: int = 3, duplicates: float = 0.5, bleu: float = 0.75, jaccard: float = 0.85) -> DataFrame:
    """rows with `cluster` (of group_clusters) -> (group, n, n_distinct, duplicate_rate, effective, effective_self_bleu, min_jaccard,
    failures, eligible). Effective candidates are the first of each cluster; a failure is prompt_mismatch, unexpected_size,
    too_few_effective, too_many_duplicates, self_bleu or no_pairable."""
    listed = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(T.normal_form(F.col(text_col))).alias("n_distinct"), F.count_distinct(prompt).alias("__prompts"),
        F.array_sort(F.collect_list(F.when(F.col("cluster") == F.col(position), F.struct(F.col(position).alias("i"), F.col(text_col).alias("t"))))).alias("__heads"),
    )
    heads = F.transform("__heads", lambda h: T.words(h["t"]))
    pairs = F.flatten(F.transform(heads, lambda a, i: F.transform(F.slice(heads, i + 2, F.size(heads)), lambda b: T.jaccard(F.array_distinct(a), F.array_distinct(b), 1.0))))
    out = listed.withColumns({"duplicate_rate": 1 - F.col("n_distinct") / F.col("n"), "effective": F.size("__heads"), "effective_self_bleu": self_bleu(F.transform("__heads", lambda h: T.tokens(h["t"]))), "min_jaccard": F.array_min(pairs)})
    failed = labels({
        "prompt_mismatch": F.col("__prompts") != 1, "unexpected_size": F.col("n") != size, "too_few_effective": F.col("effective") < least, "too_many_duplicates": F.col("duplicate_rate") > duplicates,
        "self_bleu": F.coalesce(F.col("effective_self_bleu") > bleu, F.lit(True)), "no_pairable": F.coalesce(F.col("min_jaccard") > jaccard, F.lit(True)),
    })
    return out.withColumn("failures", failed).withColumn("eligible", F.size("failures") == 0).drop("__prompts", "__heads")


def tentative_pairs(candidates: DataFrame, gap: float = 1.0, likeness: float = 0.85) -> DataFrame:
    """candidates(group, candidate, position, query, margin, shadow_margin, shadow_rank, chosen_ok, rejected_ok) -> (group, chosen,
    rejected, margin_gap, reason), one row a group.

    Chosen is the admissible one with the greatest margin, rejected the admissible one with the greatest margin at least `gap`
    below whose words differ enough; a shadow judge that ranks them the other way vetoes the pair. reason tells the first step
    that failed, null where there is a pair. Groups are a few candidates of one prompt."""
    best = F.min_by(F.struct("candidate", "query", "margin", "shadow_margin", "shadow_rank"), F.struct(-F.col("margin"), F.col("position")))
    tops = candidates.where("chosen_ok").groupBy("group").agg(best.alias("c"))
    others = candidates.where("rejected_ok").join(tops, "group").where(F.col("candidate") != F.col("c.candidate"))
    below = F.col("margin") <= F.col("c.margin") - gap
    differs = T.jaccard(T.words(F.col("query")), T.words(F.col("c.query")), 1.0) <= likeness
    pick = F.min_by(F.struct("candidate", "margin", "shadow_margin", "shadow_rank"), F.when(below & differs, F.struct(-F.col("margin"), F.col("position"))))
    found = others.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(below.cast("long")).alias("n_below"), F.sum((below & differs).cast("long")).alias("n_fit"), pick.alias("r"))
    veto = (F.col("c.shadow_margin") < F.col("r.shadow_margin")) | (F.col("c.shadow_rank") > F.col("r.shadow_rank"))
    reason = F.when(F.col("c").isNull(), "no_chosen").when(F.coalesce("n", F.lit(0)) == 0, "no_rejected").when(F.col("n_below") == 0, "no_gap").when(F.col("n_fit") == 0, "near_duplicate").when(F.coalesce(veto, F.lit(False)), "shadow_veto")
    out = candidates.select("group").distinct().join(tops, "group", "left").join(found, "group", "left").withColumn("reason", reason)
    shown = lambda c: F.when(F.col("reason").isNull(), c)
    return out.select("group", shown(F.col("c.candidate")).alias("chosen"), shown(F.col("r.candidate")).alias("rejected"), shown(F.col("c.margin") - F.col("r.margin")).alias("margin_gap"), "reason")


#: Overlap up to which a query on axis B may be chosen and from which on it may be rejected, and the likeness of words
#: beyond which two queries are near duplicates.
OVERLAP, LIKENESS = (0.0556, 0.0857), 0.85


def axis_order(group: Column, salt: str) -> Column:
    """The axes in the order in which a group tries them, by the parity of a digest."""
    last = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.lit("\0"), group.cast("string")), 256), 16, 1), 16, 10).cast("int")
    return F.when(last % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("B"), F.lit("A")))


def may_be(overlap: tuple[float, float] = OVERLAP) -> dict[str, tuple[Column, Column]]:
    """Axis -> (may be chosen, may be rejected), of a candidate's columns verdict, clean, format_ok, round_trip and overlap. Only the
    verdict yes opens the chosen role. Axis A rejects a verdict no or a missed round trip, axis B a certified copy; uncertain is no defect."""
    yes, hit = F.coalesce(F.col("verdict") == "yes", F.lit(False)), F.coalesce(F.col("round_trip") >= 1, F.lit(False))
    ok, good = F.coalesce(F.col("format_ok"), F.lit(False)), yes & F.coalesce(F.col("clean"), F.lit(False))
    low, high = (F.coalesce(c, F.lit(False)) for c in (F.col("overlap") <= overlap[0], F.col("overlap") >= overlap[1]))
    return {"A": (good, ok & (F.coalesce(F.col("verdict") == "no", F.lit(False)) | ~hit)), "B": (good & low, ok & yes & hit & high)}


def defect_pairs(candidates: DataFrame, salt: str, overlap: tuple[float, float] = OVERLAP, likeness: float = LIKENESS) -> DataFrame:
    """candidates(group, eligible, candidate, position, query, prompt, verdict, clean, format_ok, round_trip, overlap, margin, defects)
    -> one row a group: (group, axis_order, attempts, axis, chosen, rejected, likeness, chosen_distinctness, rejected_typicality,
    margin_delta, rejected_defects, failure_reasons).

    A group tries its axes in order. On each, the chosen one is the admissible candidate whose words are least like those of the group's
    others on the mean, the rejected one the admissible other that is most like them and yet not a near duplicate of the chosen; ties by
    position, then candidate. attempts tells for each axis tried (axis, n_chosen, n_rejected, failure_reason): no_admissible_chosen,
    no_axis_defect_rejected, near_duplicate_query_pair, or null where the pair was made. `defects`, an array of names, only goes along; margins
    don't decide. A group that isn't eligible makes no attempt. In an eligible group a null verdict or a second prompt is an error.
    Groups are a few candidates of one prompt and are one array each."""
    sides = {f"{axis.lower()}_{side}": test for axis, pair in may_be(overlap).items() for side, test in zip(("chosen", "rejected"), pair)}
    one = F.struct("position", "candidate", F.array_distinct(T.words(F.coalesce("query", F.lit("")))).alias("words"), "margin", F.coalesce("defects", F.array().cast("array<string>")).alias("defects"), *(c.alias(n) for n, c in sides.items()))
    checked = F.when(F.coalesce(F.col("eligible"), F.lit(False)) & F.col("verdict").isNull(), F.raise_error(F.concat(F.lit("no verdict for "), F.col("candidate").cast("string")))).otherwise(F.lit(True))
    each = candidates.select("group", F.coalesce("eligible", F.lit(False)).alias("eligible"), "prompt", F.when(checked, one).alias("one"))
    listed = each.groupBy("group").agg(
        F.bool_and("eligible").alias("eligible"), (F.min("prompt") != F.max("prompt")).alias("prompts"), F.bool_or(F.col("one.a_chosen") | F.col("one.b_chosen")).alias("__any"),
        F.sort_array(F.collect_list("one")).alias("rows"),
    )
    whole = listed.where(F.when(F.col("eligible") & F.col("prompts"), F.raise_error(F.concat(F.lit("more than one prompt in group "), F.col("group").cast("string")))).otherwise(F.lit(True)))
    like = lambda a, b: T.set_jaccard(a["words"], b["words"], 1.0)
    total = lambda r: F.aggregate("rows", F.lit(0.0), lambda s, o: s + F.when(o["candidate"] == r["candidate"], 0.0).otherwise(like(r, o)))
    # a mean decides only in a group that has someone to choose, and only of those that have a role
    asked = lambda r: F.col("eligible") & F.col("__any") & (r["a_chosen"] | r["a_rejected"] | r["b_chosen"] | r["b_rejected"])
    mean = lambda r: F.when(F.size("rows") > 1, total(r) / (F.size("rows") - 1)).otherwise(0.0)
    measured = whole.withColumn("rows", F.transform("rows", lambda r: r.withField("mean", F.when(asked(r), mean(r)))))
    first = lambda rows, sign: F.array_min(F.transform(rows, lambda r: F.struct((sign * r["mean"]).alias("by"), r["position"].alias("position"), r["candidate"].alias("candidate"), r.alias("row"))))["row"]

    def made(on_a: Column) -> Column:
        role = lambda r, side: F.when(on_a, r[f"a_{side}"]).otherwise(r[f"b_{side}"])

        def of(p: Column, c: Column, others: Column, r: Column) -> Column:
            reason = F.when(F.size(p["chosen"]) == 0, "no_admissible_chosen").when(F.size(others) == 0, "no_axis_defect_rejected").when(r.isNull(), "near_duplicate_query_pair")
            log = F.struct(F.when(on_a, "A").otherwise("B").alias("axis"), F.size(p["chosen"]).alias("n_chosen"), F.size(p["rejected"]).alias("n_rejected"), reason.alias("failure_reason"))
            shown = lambda x, *more: F.struct(*(x[n].alias(n) for n in ("candidate", "mean", "margin", *more)))
            return F.struct(log.alias("log"), shown(c).alias("chosen"), shown(r, "defects").alias("rejected"), F.when(reason.isNull(), like(c, r)).alias("likeness"))

        parts = F.struct(F.filter("rows", lambda r: role(r, "chosen")).alias("chosen"), F.filter("rows", lambda r: role(r, "rejected")).alias("rejected"))
        fit = lambda c, others: first(F.filter(others, lambda r: like(c, r) <= likeness), F.lit(-1.0))
        rest = lambda p, c: F.filter(p["rejected"], lambda r: r["candidate"] != c["candidate"])
        return T.bound(parts, lambda p: T.bound(first(p["chosen"], F.lit(1.0)), lambda c: T.bound(rest(p, c), lambda others: T.bound(fit(c, others), lambda r: of(p, c, others, r)))))

    failure = lambda t: F.col(f"{t}.log.failure_reason")
    out = measured.withColumn("axis_order", axis_order(F.col("group"), salt)).withColumn("__on_a", F.col("axis_order")[0] == "A")
    out = out.withColumn("__1", F.when(F.col("eligible"), made(F.col("__on_a"))))
    out = out.withColumn("__2", F.when(F.col("eligible") & failure("__1").isNotNull(), made(~F.col("__on_a")))).drop("rows")
    out = out.withColumn("__done", F.when(failure("__1").isNull(), F.col("__1")).when(failure("__2").isNull(), F.col("__2")))
    failed = F.when(~F.col("eligible"), F.array(F.lit("group_not_gate_eligible"))).when(F.col("__done").isNull(), F.array_sort(F.array_distinct(F.array(failure("__1"), failure("__2"))))).otherwise(F.array().cast("array<string>"))
    return out.select(
        "group", "axis_order", F.array_compact(F.array("__1.log", "__2.log")).alias("attempts"), F.col("__done.log.axis").alias("axis"), F.col("__done.chosen.candidate").alias("chosen"), F.col("__done.rejected.candidate").alias("rejected"), F.col("__done.likeness").alias("likeness"),
        F.col("__done.chosen.mean").alias("chosen_distinctness"), F.col("__done.rejected.mean").alias("rejected_typicality"), (F.col("__done.chosen.margin") - F.col("__done.rejected.margin")).alias("margin_delta"), F.col("__done.rejected.defects").alias("rejected_defects"), failed.alias("failure_reasons"),
    )


def defect_supply(candidates: DataFrame, tests: dict[str, Column], clean: Column, likeness: float = LIKENESS) -> DataFrame:
    """candidates(group, candidate, query), tests on them by name -> (defect, candidates, groups, pairable_groups): how many candidates and
    groups have each defect, and how many groups have a pair: a clean candidate and another with the defect, not near duplicates."""
    each = candidates.select("group", "candidate", F.array_distinct(T.words(F.coalesce("query", F.lit("")))).alias("words"), labels(tests).alias("defects"), F.coalesce(clean, F.lit(False)).alias("clean"))
    listed = each.groupBy("group").agg(F.collect_list(F.struct("candidate", "words", "defects", "clean")).alias("rows"))
    good = F.filter("rows", lambda r: r["clean"])
    found = listed.select("group", good.alias("good"), F.explode(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["defects"])))).alias("defect"), "rows")
    bad = F.filter("rows", lambda r: F.array_contains(r["defects"], F.col("defect")))
    pair = F.exists("bad", lambda b: F.exists("good", lambda g: (g["candidate"] != b["candidate"]) & (T.jaccard(g["words"], b["words"], 1.0) <= likeness)))
    return found.withColumn("bad", bad).groupBy("defect").agg(F.sum(F.size("bad")).alias("candidates"), F.count(F.lit(1)).alias("groups"), F.count_if(pair).alias("pairable_groups"))


def verdict_id(version: str, query: Column, passage: Column) -> Column:
    """What a verdict is kept under: the first 24 digits of a digest."""
    return F.substring(F.sha2(F.concat_ws("\0", F.lit(version), query, passage), 256), 1, 24)


def verdicts(journal: DataFrame, item: str, verdict: str) -> DataFrame:
    """(item, verdict, n); an item with two different verdicts is an error."""
    found = journal.where(F.col(verdict).isNotNull()).groupBy(item).agg(F.min(verdict).alias("v"), F.max(verdict).alias("__m"), F.count(F.lit(1)).alias("n"))
    return found.select(item, F.when(F.col("v") == F.col("__m"), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("conflicting verdicts for "), F.col(item).cast("string")))).alias(verdict), "n")


def unblinded(exported: DataFrame, answers: DataFrame, pair_id: str, secret: str) -> DataFrame:
    """exported (of blind_export), answers(pair_id, rater, picked 'a' or 'b' or 'tie') -> (pair_id, rater, prefers: left, right or tie).
    A commitment that secret and orientation don't give is an error."""
    digest = F.sha2(F.concat_ws(":", F.lit(secret), F.col(pair_id).cast("string")), 256)
    kept = F.sha2(F.concat_ws(":", digest, F.when(F.col("swapped"), "swapped").otherwise("straight")), 256) == F.col("commitment")
    side = F.when(F.col("picked") == "tie", "tie").when((F.col("picked") == "a") != F.col("swapped"), "left").otherwise("right")
    return answers.join(exported.select(pair_id, "swapped", "commitment"), pair_id).select(pair_id, "rater", F.when(kept, side).otherwise(F.raise_error(F.lit("a commitment doesn't match"))).alias("prefers"))


def consensus(preferences: DataFrame, pair_id: str) -> DataFrame:
    """(pair_id, raters, state): unanimous, majority or split, and what is preferred, null where split."""
    counts = preferences.groupBy(pair_id, "prefers").agg(F.count(F.lit(1)).alias("c"))
    g = counts.groupBy(pair_id).agg(F.sum("c").alias("raters"), F.max("c").alias("top"), F.max_by("prefers", "c").alias("p"))
    state = F.when(F.col("top") == F.col("raters"), "unanimous").when(2 * F.col("top") > F.col("raters"), "majority").otherwise("split")
    return g.select(pair_id, "raters", state.alias("state"), F.when(state != "split", F.col("p")).alias("preferred"))


def evidence(candidates: DataFrame, components: dict[str, DataFrame], key: str) -> DataFrame:
    """candidates with each component's columns as a struct of its name, null where it is missing, and `missing`, the sorted names
    of what is. A component with two rows of one key is an error."""
    out = candidates
    for name, df in components.items():
        fields = [c for c in df.columns if c != key]
        one = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*fields)).alias("__r"))
        checked = one.select(F.col(key), F.when(F.col("__n") == 1, F.col("__r")).otherwise(F.raise_error(F.concat(F.lit(f"{name} repeats "), F.col(key).cast("string")))).alias(name))
        out = out.join(checked, key, "left")
    return out.withColumn("missing", labels({n: F.col(n).isNull() for n in components}))


def margin_mismatches(rows: DataFrame, margin: str, chosen: str, rejected: str, tolerance: float = 1e-6) -> DataFrame:
    """The rows whose margin isn't chosen minus rejected, within the tolerance; a null anywhere is one."""
    return rows.where(F.coalesce(F.abs(F.col(margin) - (F.col(chosen) - F.col(rejected))) > tolerance, F.lit(True)))


def slot_gaps(rows: DataFrame, group: str, slot: str, slots: int, required: Sequence[str] = ()) -> DataFrame:
    """(group, present, repeated, incomplete, missing): of groups that should have slots 0 to slots - 1 once, with all required
    fields; only groups with a fault."""
    full = F.lit(True)
    for c in required:
        full = full & F.col(c).isNotNull()
    g = rows.groupBy(group).agg(F.count_distinct(slot).alias("present"), (F.count(slot) - F.count_distinct(slot)).alias("repeated"), F.sum((~full).cast("long")).alias("incomplete"), F.collect_set(slot).alias("__s"))
    missing = F.array_except(F.sequence(F.lit(0), F.lit(slots - 1)), F.transform("__s", lambda x: x.cast("int")))
    return g.select(group, "present", "repeated", "incomplete", F.array_sort(missing).alias("missing")).where((F.size("missing") > 0) | (F.col("repeated") > 0) | (F.col("incomplete") > 0))


def identity_conflicts(rows: DataFrame, key: str, identities: Sequence[str]) -> DataFrame:
    """(key, field, n_values): keys under which a field that should be one has several values."""
    each = rows.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in identities))).alias("x")).select(key, "x.*")
    return each.groupBy(key, "field").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")
