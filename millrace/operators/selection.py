"""Sampling, allocation, per-group selection and preference pairs."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import ranked_within, written


def hash_order(id_: Column, seed: str) -> Column:
    """A hexadecimal digest of seed and id; the lowest come first."""
    return F.sha2(F.concat_ws(":", F.lit(seed), id_.cast("string")), 256)


def hash_sample(rows: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """The n rows that come first in hash order; ties by id."""
    return rows.withColumn("order_key", hash_order(F.col(id_col), seed)).orderBy("order_key", id_col).limit(n)


def top_per_group(rows: DataFrame, by: Sequence[str], quality: str, id_col: str, n: int) -> DataFrame:
    """rows with `rank`, the n best of each group by quality, ties by id."""
    order = Window.partitionBy(*by).orderBy(F.desc(quality), id_col)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def largest_remainder(counts: DataFrame, stratum: str, n: str, total: int) -> DataFrame:
    """counts(stratum, n) -> (stratum, n, quota): shares of total in proportion, whole numbers; the largest remainders round up."""
    all_ = F.broadcast(counts.agg(F.sum(n).alias("__all")))
    exact = counts.join(all_).withColumn("__x", F.col(n).cast("double") * total / F.col("__all")).withColumn("__floor", F.floor("__x"))
    left = F.broadcast(exact.agg((F.lit(total) - F.sum("__floor")).alias("__left")))
    order = Window.orderBy(F.desc(F.round(F.col("__x") - F.col("__floor"), 9)), stratum)
    return exact.join(left).withColumn("__i", F.row_number().over(order)).select(stratum, n, (F.col("__floor") + (F.col("__i") <= F.col("__left")).cast("long")).cast("long").alias("quota"))


def stratified_sample(rows: DataFrame, quotas: DataFrame, stratum: str, id_col: str, seed: str) -> DataFrame:
    """Of each stratum its quota of rows, first in hash order. A stratum of any size is ranked over many tasks."""
    placed = ranked_within(rows.join(quotas.select(stratum, "quota"), stratum), [stratum], hash_order(F.col(id_col), seed), id_col, name="__i")
    return placed.where(F.col("__i") < F.col("quota")).select(*rows.columns)


def common_groups(rows: DataFrame, group: str, arm: str, item: str, k: int, arms: int) -> DataFrame:
    """(group): groups with exactly k items in each of all arms."""
    full = rows.groupBy(group, arm).agg(F.count_distinct(item).alias("n")).where(F.col("n") == k)
    return full.groupBy(group).agg(F.count(F.lit(1)).alias("arms")).where(F.col("arms") == arms).select(group)


#: What a new term, focus, form and length bucket are worth, and what repeating a candidate costs.
GAINS = {"diversity": 0.25, "terms": 0.0, "focus": 0.0, "form": 0.0, "bucket": 0.0, "duplicate": 0.0}


def greedy_cover(candidates: DataFrame, group: str, id_col: str, n: int, **gains: float) -> DataFrame:
    """candidates(group, id, quality, terms, and optionally focus, form, bucket) -> (group, id, position), one after another the
    candidate with the greatest score: quality, less the greatest likeness of its terms to a chosen one, more for each term, focus,
    form and bucket that no chosen one has, less if its terms are all those of a chosen one; weights: GAINS. Ties go to the
    greater quality, then the greater id. With only diversity this is maximal marginal relevance.

    A group is some candidates of one passage and is one call. Scores are arrays, updated by what the last choice changed."""
    weight = GAINS | gains
    labels = [c for c in ("focus", "form", "bucket") if c in candidates.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_col]).reset_index(drop=True)
        terms = sorted({t for ts in pdf["terms"] for t in ts})
        column = {t: k for k, t in enumerate(terms)}
        has = np.zeros((len(pdf), max(1, len(terms))), bool)
        for row, ts in enumerate(pdf["terms"]):
            has[row, [column[t] for t in ts]] = True
        sizes, score = has.sum(1), pdf["quality"].to_numpy(np.float64)
        likest, twin = np.zeros(len(pdf)), np.zeros(len(pdf), bool)
        seen, known = np.zeros(has.shape[1], bool), {c: set() for c in labels}
        codes, free, order = {c: pdf[c].to_numpy() for c in labels}, np.ones(len(pdf), bool), []
        while len(order) < min(n, len(pdf)):
            new = sum((weight[c] * np.array([x is not None and x not in known[c] for x in codes[c]]) for c in labels), np.zeros(len(pdf)))
            total = score - weight["diversity"] * likest + weight["terms"] * (has & ~seen).sum(1) + new - weight["duplicate"] * twin
            best = np.lexsort((np.arange(len(pdf)), score, np.where(free, total, -np.inf)))[-1]
            order.append(best)
            free[best] = False
            common = (has & has[best]).sum(1)
            union = sizes + sizes[best] - common
            likest = np.maximum(likest, np.where(union > 0, common / np.maximum(union, 1), 1.0))
            twin |= (common == sizes) & (common == sizes[best])
            seen |= has[best]
            for c in labels:
                known[c].add(codes[c][best])
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(order), id_col: pdf[id_col].iloc[order], "position": range(1, len(order) + 1)})

    schema = f"{group} {candidates.schema[group].dataType.simpleString()}, {id_col} {candidates.schema[id_col].dataType.simpleString()}, position long"
    return candidates.select(group, id_col, "quality", "terms", *labels).groupBy(group).applyInPandas(run, schema)


def group_diversity(rows: DataFrame, group: str, id_col: str, text_col: str) -> DataFrame:
    """(group, n, distinct_1, distinct_2, mean_jaccard, max_jaccard, duplicate_share) of the texts of each group.

    Pairs are made within groups of a few candidates for one prompt."""
    t = rows.select(F.col(group).alias("g"), F.col(id_col).alias("i"), T.tokens(F.col(text_col)).alias("tokens"), T.normal_form(F.col(text_col)).alias("form"))
    t = t.withColumn("terms", F.array_distinct(T.content(F.col("tokens"))))
    two = F.when(F.size("tokens") >= 2, T.shingles(F.col("tokens"), 2)).otherwise(F.array().cast("array<string>"))
    grams = t.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("tokens")).alias("one"), F.flatten(F.collect_list(two)).alias("two"), (1 - F.count_distinct("form") / F.count(F.lit(1))).alias("duplicate_share")
    )
    ratio = lambda c: T.share(F.array_distinct(c), F.col(c), None)
    a, b = t.select("g", F.col("i").alias("ia"), F.col("terms").alias("ta")), t.select(F.col("g").alias("gb"), F.col("i").alias("ib"), F.col("terms").alias("tb"))
    pairs = a.join(b, (F.col("g") == F.col("gb")) & (F.col("ia") < F.col("ib"))).select("g", T.jaccard(F.col("ta"), F.col("tb"), 1.0).alias("j"))
    likeness = pairs.groupBy("g").agg(F.avg("j").alias("mean_jaccard"), F.max("j").alias("max_jaccard"))
    return grams.join(likeness, "g", "left").select(F.col("g").alias(group), "n", ratio("one").alias("distinct_1"), ratio("two").alias("distinct_2"), "mean_jaccard", "max_jaccard", "duplicate_share")


def preference_pairs(candidates: DataFrame, margin: float, likeness: float, most: int = 1, near_miss: bool = True) -> DataFrame:
    """candidates(split, passage, candidate, query, score, chosen_ok, rejected_ok) -> (split, passage, chosen, rejected,
    margin, rank): the best candidate that may be chosen against at most `most` worse and different enough ones."""
    group = ["split", "passage"]
    best = Window.partitionBy(*group).orderBy(F.desc("score"), "candidate")
    chosen = candidates.where("chosen_ok").withColumn("__i", F.row_number().over(best)).where("__i = 1").select(*group, F.col("candidate").alias("chosen"), F.col("score").alias("top"), F.array_distinct(T.words(F.col("query"))).alias("qa"))
    others = candidates.where("rejected_ok").select(*group, F.col("candidate").alias("rejected"), "score", F.array_distinct(T.words(F.col("query"))).alias("qb"))
    near = others.join(chosen, group).where((F.col("rejected") != F.col("chosen")) & (F.col("top") - F.col("score") >= margin))
    common = F.size(F.array_intersect("qa", "qb"))
    union = F.size("qa") + F.size("qb") - common  # both are sets
    pairs = near.where(F.when(union > 0, common / union).otherwise(1.0) <= likeness)
    order = Window.partitionBy(*group).orderBy(F.desc("score") if near_miss else F.asc("score"), "rejected")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select(*group, "chosen", "rejected", (F.col("top") - F.col("score")).alias("margin"), "rank")


def pair_sets(pairs: DataFrame) -> DataFrame:
    """(split, passage, set_id, chosen, n_rejected): preference_pairs by passage, with an id made of the candidates'."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "rejected"))), lambda x: x["rejected"].cast("string"))
    out = pairs.groupBy("split", "passage", "chosen").agg(listed.alias("r"))
    return out.select("split", "passage", F.substring(F.sha2(F.concat_ws("\0", F.col("chosen").cast("string"), F.array_join("r", "\0")), 256), 1, 24).alias("set_id"), "chosen", F.size("r").cast("long").alias("n_rejected"))


def blind_export(pairs: DataFrame, pair_id: str, left: str, right: str, secret: str) -> DataFrame:
    """pairs with (swapped, shown_a, shown_b, commitment): which side is shown first depends on secret and id; the commitment
    proves it later without telling now."""
    digest = F.sha2(F.concat_ws(":", F.lit(secret), F.col(pair_id).cast("string")), 256)
    swapped = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") >= 128
    side = lambda a, b: F.when(swapped, F.col(b)).otherwise(F.col(a))
    return pairs.select("*", swapped.alias("swapped"), side(left, right).alias("shown_a"), side(right, left).alias("shown_b"), F.sha2(F.concat_ws(":", digest, F.when(swapped, "swapped").otherwise("straight")), 256).alias("commitment"))


def best_subset(candidates: DataFrame, group: str, id_col: str, score: str, k: int, terms: str | None = None, weights: tuple[float, float] = (1.0, 0.0), anchor: DataFrame | None = None) -> DataFrame:
    """(group, ids, total): of all subsets of k of a group's candidates the first best by weighted mean score and, where terms are
    given, mean number of different terms; of a few candidates. anchor(group, least): subsets whose mean score is below it don't count."""
    cols = candidates.select(group, id_col, F.col(score).cast("double").alias("__s"), (F.col(terms) if terms else F.array().cast("array<string>")).alias("__t"))
    cols = cols.join(anchor.select(group, F.col("least").cast("double").alias("__least")), group, "left") if anchor is not None else cols.withColumn("__least", F.lit(None).cast("double"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        rows, least = list(zip(pdf[id_col], pdf["__s"], pdf["__t"])), pdf["__least"].iloc[0]
        found = []
        for c in itertools.combinations(rows, k):
            mean = sum(s for _, s, _ in c) / k
            if pd.isna(least) or mean >= least:
                found.append((weights[0] * mean + weights[1] * len({t for _, _, ts in c for t in ts}) / k, [i for i, _, _ in c]))
        best = max(found, key=lambda x: x[0], default=None)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "ids": [best[1]], "total": [best[0]]} if best else {group: pdf[group][:0], "ids": pd.Series([], dtype=object), "total": np.zeros(0)})

    return cols.groupBy(group).applyInPandas(run, f"{group} {candidates.schema[group].dataType.simpleString()}, ids array<{candidates.schema[id_col].dataType.simpleString()}>, total double")


#: What a subset's parts weigh in its score.
SUBSET_WEIGHTS = {"alignment": 0.3, "semantic_diversity": 0.25, "lexical_diversity": 0.2, "specificity": 0.15, "low_copy": 0.1}


def feasible_subsets(candidates: DataFrame, group: str, id_col: str, metrics: Sequence[str], scale: float, weights: dict[str, float] | None = None, size: int = 8, k: int = 4) -> DataFrame:
    """candidates(group, id, anchor boolean, copy_risk boolean, copy_density, margin_excess, n_effective, n_corpus, terms, vector, metrics...)
    -> (group, ids, changed, score, alignment, semantic_diversity, lexical_diversity, specificity, low_copy, mean_cosine): of all subsets
    of k of a group's `size` candidates the best feasible one, the first in order of ids where scores are within 1e-12.

    Feasible: no more risky copies than the anchor, and no metric's mean below the anchor's. Score: weighted sum of the mean of
    exp(-|margin_excess| / scale), 1 - mean pairwise cosine (within 0 and 1), 1 - mean pairwise Jaccard of terms, the mean of
    1 - log1p(n_effective) / log1p(n_corpus), and 1 - mean copy_density. Vectors have length one. changed: it isn't the anchor. Another
    number of candidates or anchors in a group is an error. Subsets are lists of places, all in expressions of the JVM."""
    weigh = weights or SUBSET_WEIGHTS
    number = lambda c: F.col(c).cast("double")
    one = F.struct(
        F.col(id_col).alias("id"), F.col("anchor").alias("anchor"), F.col("copy_risk").cast("int").cast("double").alias("risk"), number("copy_density").alias("density"), F.exp(-F.abs(number("margin_excess")) / scale).alias("near"),
        (1 - F.log1p(number("n_effective")) / F.log1p(number("n_corpus"))).alias("specific"), F.array_distinct("terms").alias("terms"), F.col("vector").cast("array<double>").alias("v"), F.array(*map(number, metrics)).alias("metrics"),
    )
    listed = candidates.groupBy(F.col(group).alias("g")).agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("c"))
    right = (F.size("c") == size) & (F.size(F.filter("c", lambda x: x["anchor"])) == k)
    listed = listed.where(F.when(right, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"not {size} candidates with {k} anchors in group "), F.col("g").cast("string")))))
    pairs = list(itertools.combinations(range(size), 2))
    at = lambda i: F.get("c", i)
    dot = lambda a, b: F.aggregate(F.zip_with(a["v"], b["v"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    known = listed.withColumns({"cosine": F.array(*(dot(at(i), at(j)) for i, j in pairs)), "alike": F.array(*(T.jaccard(at(i)["terms"], at(j)["terms"], 1.0) for i, j in pairs)), "places": F.array_compact(F.transform("c", lambda x, i: F.when(x["anchor"], i)))})
    subsets = F.array(*(F.struct(F.array(*map(F.lit, c)).alias("items"), F.array(*(F.lit(n) for n, p in enumerate(pairs) if set(p) <= set(c))).alias("pairs")) for c in itertools.combinations(range(size), k)))
    total = lambda places, of: F.aggregate(places, F.lit(0.0), lambda s, i: s + of(i))
    mean = lambda places, field: total(places, lambda i: F.get("c", i)[field]) / k
    metric = lambda places, m: total(places, lambda i: F.get(F.get("c", i)["metrics"], m)) / k
    bar = known.withColumn("bar", F.struct(total(F.col("places"), lambda i: F.get("c", i)["risk"]).alias("risk"), F.array(*(metric(F.col("places"), m) for m in range(len(metrics)))).alias("metrics")))

    def scored(s: Column) -> Column:
        feasible = total(s["items"], lambda i: F.get("c", i)["risk"]) <= F.col("bar.risk")
        for m in range(len(metrics)):
            feasible = feasible & (metric(s["items"], m) + 1e-12 >= F.get("bar.metrics", m))
        cosine = total(s["pairs"], lambda p: F.get("cosine", p)) / (k * (k - 1) // 2)
        parts = {
            "alignment": mean(s["items"], "near"), "semantic_diversity": F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - cosine)), "lexical_diversity": 1 - total(s["pairs"], lambda p: F.get("alike", p)) / (k * (k - 1) // 2),
            "specificity": mean(s["items"], "specific"), "low_copy": 1 - mean(s["items"], "density"),
        }
        return F.struct(s["items"].alias("items"), feasible.alias("feasible"), *(c.alias(n) for n, c in parts.items()), cosine.alias("mean_cosine"))

    found = bar.withColumn("s", F.filter(F.transform(subsets, scored), lambda s: s["feasible"]))
    whole = lambda s: sum((F.lit(float(w)) * s[n] for n, w in weigh.items()), F.lit(0.0))
    ranked = found.withColumn("s", F.transform("s", lambda s: s.withField("score", whole(s))))
    best = F.aggregate(F.slice("s", 2, 1 << 20), F.get("s", 0), lambda b, s: F.when(s["score"] > b["score"] + 1e-12, s).otherwise(b))
    out = ranked.withColumn("b", best)
    names = ("score", *SUBSET_WEIGHTS, "mean_cosine")
    return out.select(F.col("g").alias(group), F.transform("b.items", lambda i: F.get("c", i)["id"]).alias("ids"), (F.col("b.items") != F.col("places")).alias("changed"), *(F.col(f"b.{n}").alias(n) for n in names))


def unique_cohort(rows: DataFrame, first: str, second: str, id_col: str, n: int, seed: str) -> DataFrame:
    """The n first rows in hash order of which no two share the value of `first` or of `second`, taking a row if no earlier taken one
    shares either: as one pass over the order would. Values that are null are shared with none.

    In rounds: a row that is first of both its values among those still open is taken, and rows that share a value with it are
    closed. The first open row is always taken, and hash order keeps chains of rows that wait for one another short. Rounds end when n
    taken rows stand before every open one, or none is open."""
    order = F.struct(hash_order(F.col(id_col), seed).alias("h"), F.col(id_col).cast("string").alias("i"))
    keyed = written(rows.select(F.struct("*").alias("__row"), order.alias("__o"), *(F.coalesce(F.col(c).cast("string"), F.concat(F.lit("\0"), F.col(id_col).cast("string"))).alias(k) for c, k in ((first, "__a"), (second, "__b")))), "cohort")
    open_, taken = keyed, None
    while True:
        firsts = [open_.groupBy(k).agg(F.min("__o").alias(f"{k}_first")) for k in ("__a", "__b")]
        marked = open_.join(firsts[0], "__a").join(firsts[1], "__b")
        mine = marked.where((F.col("__o") == F.col("__a_first")) & (F.col("__o") == F.col("__b_first"))).select(*open_.columns)
        taken = written(mine if taken is None else taken.unionByName(mine), "cohort")
        open_ = written(open_.join(taken.select("__a"), "__a", "left_anti").join(taken.select("__b"), "__b", "left_anti"), "cohort")
        next_ = open_.agg(F.min("__o").alias("o")).first()["o"]
        if next_ is None or taken.where(F.col("__o") < F.struct(F.lit(next_["h"]).alias("h"), F.lit(next_["i"]).alias("i"))).limit(n).count() == n:
            return taken.orderBy("__o").limit(n).select("__row.*")


def audit_strata(rows: DataFrame, id_col: str, score: str, margin: str, flagged: str, n: int, seed: str) -> DataFrame:
    """(id_col, stratum): four disjoint samples of n in hash order, each from what the ones before left: low_score (the lowest
    decile of score), low_margin (of margin), flagged, control. A decile ends at place ceil(n / 10) of the sorted values."""
    from .statistics import index_quantile

    whole = rows.withColumn("__all", F.lit(1))
    limits = [index_quantile(whole, ["__all"], c, 0.1, ceil=True).first() for c in (score, margin)]
    low = [F.coalesce(F.col(c) <= (x["quantile"] if x else None), F.lit(False)) for c, x in zip((score, margin), limits)]
    left, out = rows, None
    for name, test in (("low_score", low[0]), ("low_margin", low[1]), ("flagged", F.coalesce(F.col(flagged), F.lit(False))), ("control", F.lit(True))):
        mine = hash_sample(left.where(test), id_col, n, f"{seed}-{name}").select(id_col, F.lit(name).alias("stratum"))
        out = mine if out is None else out.unionByName(mine)
        left = rows.join(out.select(id_col), id_col, "left_anti")
    return out


def axis_quotas(supply: dict[str, int], quotas: dict[str, int]) -> dict[str, int]:
    """What each axis gives: its quota or its supply; what is short goes to the axes with supply left, the largest rest first."""
    given = {a: min(quotas[a], supply.get(a, 0)) for a in quotas}
    short = sum(quotas.values()) - sum(given.values())
    for a in sorted(quotas, key=lambda a: (given[a] - supply.get(a, 0), a)):
        more = min(short, supply.get(a, 0) - given[a])
        given[a], short = given[a] + more, short - more
    return given


def sample_by_axis(pairs: DataFrame, axis: str, id_col: str, quotas: dict[str, int], seed: str) -> DataFrame:
    """Pairs by axis_quotas of what is there, in hash order; axes are few."""
    supply = {r[axis]: r["count"] for r in pairs.groupBy(axis).count().collect()}
    given = axis_quotas(supply, quotas)
    parts = [hash_sample(pairs.where(F.col(axis) == a), id_col, n, seed).drop("order_key") for a, n in given.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def exemplars(rows: DataFrame, label: str, confidence: str, id_col: str, counts: dict[str, int], taken: DataFrame, seed: str, least: float = 0.9) -> DataFrame:
    """Of each label so many rows, in hash order, that are sure enough and not taken yet."""
    free = rows.where((F.col(confidence) >= least) & F.col(label).isin(*counts)).join(taken.select(id_col), id_col, "left_anti")
    want = F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))
    placed = ranked_within(free, [label], hash_order(F.col(id_col), seed), id_col, name="__i")
    return placed.where(F.col("__i") < want[F.col(label)]).select(*rows.columns)


def control_matrix(passages: DataFrame, id_col: str, axes: dict[str, Sequence[str]], k: int) -> DataFrame:
    """(id_col, slot, one column an axis): k fixed controls for every passage; axes advance side by side, each round its own length."""
    slots = passages.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    return slots.select(id_col, "slot", *(F.element_at(F.array(*map(F.lit, values)), F.col("slot") % len(values) + 1).alias(a) for a, values in axes.items()))


def request_plan(supply: DataFrame, axes: Sequence[str], n: int) -> DataFrame:
    """supply(id, axes..., one row a possible request) -> the n that cover the axes' values most evenly: requests are ranked within each
    value of each axis by hash, and the sum of their ranks decides, ties by hash. No step waits for another."""
    digest = F.sha2(F.concat_ws(":", F.lit("plan"), *(F.col(c).cast("string") for c in supply.columns)), 256)
    placed = supply.withColumn("__h", digest)
    for a in axes:
        placed = ranked_within(placed, [a], "__h", name=f"__r_{a}").drop("group_size")
    total = sum((F.col(f"__r_{a}") for a in axes[1:]), F.col(f"__r_{axes[0]}"))
    return placed.orderBy(total, "__h").limit(n).select(*supply.columns)


def measured_ranking(rows: DataFrame, id_col: str, by: Sequence[str]) -> DataFrame:
    """The rows that have all measures, with `rank` by them, greatest first, ties by id. For tables of variants."""
    full = rows.dropna(subset=list(by))
    return full.withColumn("rank", F.row_number().over(Window.orderBy(*(F.desc(c) for c in by), id_col)).cast("long"))


def rule_search(rows: DataFrame, gold: str, features: Sequence[str], precision: float = 0.88, recall: float = 0.5, cuts: int = 9) -> DataFrame:
    """The best rule of one or two tests `feature >= cut` or `feature <= cut`, cuts at deciles: (rule, precision, recall), one row or
    none. Best: the greatest recall among rules that are precise enough and reach the least recall, then precision, then name.

    Rows are reduced to the set of tests that they meet, as a number, before pairs of tests are counted."""
    ps = [k / (cuts + 1) for k in range(1, cuts + 1)]
    limits = rows.agg(*(F.percentile(f, F.array(*map(F.lit, ps))).alias(f) for f in features)).first()
    atoms = sorted({(f, side, c) for f in features for c in (limits[f] or []) for side in (">=", "<=")})
    tests = [F.coalesce(F.col(f) >= c if side == ">=" else F.col(f) <= c, F.lit(False)) for f, side, c in atoms]
    met = rows.select(F.col(gold).cast("boolean").alias("g"), F.array_compact(F.array(*(F.when(t, k) for k, t in enumerate(tests)))).alias("m")).groupBy("g", "m").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    hits = met.select("g", "n", F.explode(pairs).alias("p")).groupBy("p").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("g"), F.col("n")).otherwise(0)).alias("hit"))
    total = F.broadcast(rows.agg(F.sum(F.col(gold).cast("boolean").cast("long")).alias("__gold")))
    names = F.array(*(F.lit(f"{f} {side} {c!r}") for f, side, c in atoms))
    name = lambda i: F.get(names, i)
    rule = F.when(F.col("p.a") == F.col("p.b"), name(F.col("p.a"))).otherwise(F.concat_ws(" and ", name(F.col("p.a")), name(F.col("p.b"))))
    scored = hits.join(total).select(rule.alias("rule"), (F.col("hit") / F.col("all")).alias("precision"), (F.col("hit") / F.col("__gold")).alias("recall"))
    return scored.where((F.col("precision") >= precision) & (F.col("recall") >= recall)).orderBy(F.desc("recall"), F.desc("precision"), "rule").limit(1)


def oversampled(rows: DataFrame, label: str, id_col: str, seed: str) -> DataFrame:
    """rows repeated so that labels weigh alike: each row ceil or floor of its weight times, by a digest, with its `copy`."""
    from .statistics import hashed_uniform

    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    most = F.broadcast(counts.agg(F.max("__n").alias("__most")))  # one row
    weighed = rows.join(counts, label).join(most).withColumn("__w", F.col("__most") / F.col("__n"))
    times = F.floor("__w") + (hashed_uniform(F.lit(seed), F.col(id_col)) < F.col("__w") - F.floor("__w")).cast("long")
    return weighed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("__n", "__most", "__w")


def prospective_cohort(rows: DataFrame, excluded: Sequence[DataFrame], id_col: str, seed: str, offset: int, n: int) -> DataFrame:
    """The rows of places offset to offset + n - 1 in hash order among those that no excluded table has."""
    left = rows
    for x in excluded:
        left = left.join(x.select(id_col), id_col, "left_anti")
    return left.withColumn("order_key", hash_order(F.col(id_col), seed)).orderBy("order_key", id_col).offset(offset).limit(n)
