"""Distributions, agreement, calibration and tests."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import ranked_within, written


def running_sums(rows: DataFrame, key: str, n: str, out: str, parts: int | None = None) -> DataFrame:
    """rows(key distinct, n) with `out`, the sum of n over keys up to the row's.

    Rows are dealt into ranges of keys; each range sums up for itself, and the ranges' totals, as many rows as ranges, are
    carried from one to the next."""
    ranged = rows.repartitionByRange(parts, key) if parts else rows.repartitionByRange(key)
    ranged = written(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = ranged.groupBy("__part").agg(F.sum(n).alias("__sum")).withColumn("__from", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    local = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("__local", F.sum(n).over(local)).join(F.broadcast(carried.select("__part", "__from")), "__part").withColumn(out, F.col("__local") + F.col("__from")).drop("__part", "__local", "__from")


def distribution(value: str) -> list[Column]:
    """count, mean, least, quantiles by linear interpolation, greatest; null where there are no values."""
    points = (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), *(F.percentile(value, p).alias(n) for n, p in points), F.max(value).alias("most")]


def nearest_rank(histogram: DataFrame, value: str, n: str, p: float) -> DataFrame:
    """histogram(value, n) -> one row: the value whose running count reaches round(p * all), at least 1."""
    running = running_sums(histogram.select(value, n), value, n, "__run")
    target = F.broadcast(histogram.agg(F.greatest(F.lit(1), F.bround(F.sum(n) * p)).alias("__goal")))
    return running.join(target).where(F.col("__run") >= F.col("__goal")).agg(F.min(value).alias(value))


def entropy(counts: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """counts(by..., n) -> (by..., entropy_bits): Shannon's, from counts."""
    total = counts.groupBy(*by).agg(F.sum(n).alias("__all"), F.sum(F.when(F.col(n) > 0, F.col(n) * F.log2(n)).otherwise(0.0)).alias("__x"))
    return total.select(*by, (F.log2("__all") - F.col("__x") / F.col("__all")).alias("entropy_bits"))


def gini(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row (gini) of counts."""
    same = counts.where(F.col(n).isNotNull()).groupBy(n).agg(F.count(F.lit(1)).alias("__many"))
    upto = running_sums(same, n, "__many", "__upto")
    # counts of one value take the ranks upto - many + 1 to upto
    ranks, all_ = F.sum((2 * F.col("__upto") - F.col("__many") + 1) * F.col("__many") * F.col(n)), F.sum("__many")
    return upto.agg((ranks / (all_ * F.sum(F.col("__many") * F.col(n))) - (all_ + 1) / all_).alias("gini"))


def slice_rollup(rows: DataFrame, slices: Sequence[str], metric: str) -> DataFrame:
    """(field, value, n, mean): for each slice field and value; a missing value is 'unknown'. One pass over rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("field"), F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias("value")) for s in slices)))
    return rows.select(F.col(metric).alias("__m"), pairs.alias("s")).groupBy("s.field", "s.value").agg(F.count(F.lit(1)).alias("n"), F.avg("__m").alias("mean"))


def pearson(a: str, b: str) -> Column:
    """Null for fewer than two pairs or where one side doesn't vary."""
    return F.when((F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) >= 2) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, support, predicted_count, hits, precision, recall, f1) of each label on either side."""
    pairs = rows.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col(gold).alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p"), F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0).alias("h")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")),
    )).alias("s")).groupBy("s.label").agg(F.sum("s.g").alias("support"), F.sum("s.p").alias("predicted_count"), F.sum("s.h").alias("hits"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = sides.withColumns({"precision": ratio("hits", "predicted_count"), "recall": ratio("hits", "support")})
    return out.withColumn("f1", F.when(F.col("support") + F.col("predicted_count") > 0, 2 * F.col("hits") / (F.col("support") + F.col("predicted_count"))))


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, observed, expected, kappa); kappa is null where chance alone agrees always."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = pairs.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na")), pairs.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("cross"))
    out = total.join(F.broadcast(chance)).select("n", (F.col("same") / F.col("n")).alias("observed"), (F.col("cross") / (F.col("n").cast("double") * F.col("n"))).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def fleiss_kappa(ratings: DataFrame, item: str, label: str, raters: int) -> DataFrame:
    """ratings(item, label), as many for each item -> one row (items, agreement, expected, kappa)."""
    each = ratings.groupBy(item, label).agg(F.count(F.lit(1)).alias("c"))
    agreement = each.groupBy(item).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("x")).agg(F.count(F.lit(1)).alias("items"), (F.avg("x") / (raters * (raters - 1))).alias("agreement"))
    shares = each.groupBy(label).agg(F.sum("c").alias("t")).join(F.broadcast(agreement.select("items"))).agg(F.sum((F.col("t") / (F.col("items") * raters)) ** 2).alias("expected"))
    out = agreement.join(F.broadcast(shares))
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("agreement") - F.col("expected")) / (1 - F.col("expected"))))


def robust_z(rows: DataFrame, value: str) -> DataFrame:
    """rows with `z`: distance from the median in 1.4826 median absolute deviations, 1e-8 at least."""
    center = rows.agg(F.median(value).alias("__c"))
    with_c = rows.join(F.broadcast(center))
    scale = with_c.agg(F.greatest(1.4826 * F.median(F.abs(F.col(value) - F.col("__c"))), F.lit(1e-8)).alias("__s"))
    return with_c.join(F.broadcast(scale)).withColumn("z", (F.col(value) - F.col("__c")) / F.col("__s")).drop("__c", "__s")


def midrank(rows: DataFrame, value: str) -> DataFrame:
    """rows with `percentile`: mid-rank among the rows' own values, 0 to 1; 0.5 for a single row, null for null. Ranks go over
    distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    total = F.broadcast(rows.agg(F.count(value).alias("__all")))
    place = running_sums(counts, value, "__n", "__upto").withColumn("__left", F.col("__upto") - F.col("__n")).join(total)
    pct = F.when(F.col("__all") == 1, 0.5).otherwise((2 * F.col("__left") + F.col("__n") - 1) / 2 / (F.col("__all") - 1))
    return rows.join(place.select(value, pct.alias("percentile")), value, "left")


def rank_buckets(rows: DataFrame, value: str, tie: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """rows with `bucket`: rank * k // n by value, ties by the tie column; a group of any size is ranked over many tasks."""
    placed = ranked_within(rows, by, value, tie, name="__i")
    return placed.withColumn("bucket", F.floor(F.col("__i") * k / F.col("group_size")).cast("long")).drop("__i", "group_size")


def reliability(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy)."""
    bin_ = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def transitions(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """(before, after, n, share of before) over shared keys."""
    both = left.select(key, F.col(label).alias("before")).join(right.select(key, F.col(label).alias("after")), key)
    counts = both.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def _front(values: np.ndarray) -> np.ndarray:
    """Which rows no other row is at least as good as everywhere and better somewhere, more being better."""
    keep, left = np.zeros(len(values), bool), np.argsort(-values.sum(axis=1), kind="stable")
    while len(left):  # what has the greatest sum is dominated by nothing that is left
        best = values[left[0]]
        same = (values[left] == best).all(axis=1)
        keep[left[same]] = True
        left = left[~(values[left] <= best).all(axis=1)]
    return keep


def pareto_front(rows: DataFrame, id_col: str, up: Sequence[str], down: Sequence[str] = ()) -> DataFrame:
    """Rows that no other row is at least as good as everywhere and better somewhere. A row with a null measure is compared with none and
    stays. Each task leaves the front of its rows; only these fronts are compared with one another."""
    measures = [*up, *down]
    known = F.lit(True)
    for c in measures:
        known = known & F.col(c).isNotNull()
    signs = np.array([1.0] * len(up) + [-1.0] * len(down))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            both = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = both[_front(both[list(measures)].to_numpy(np.float64) * signs)].reset_index(drop=True)
        if held is not None:
            yield held

    fronts = written(rows.where(known).select(*(F.col(c).cast("double").alias(c) for c in measures)).mapInPandas(local, ", ".join(f"{c} double" for c in measures)), "fronts")
    other = fronts.select(*(F.col(c).alias(f"__{c}") for c in measures))
    as_good, better = F.lit(True), F.lit(False)
    for c in measures:
        mine, theirs = (F.col(c), F.col(f"__{c}")) if c in up else (F.col(f"__{c}"), F.col(c))
        as_good, better = as_good & (theirs >= mine), better | (theirs > mine)
    best = fronts.join(other, as_good & better, "left_anti").select(*(F.col(c).alias(f"__{c}") for c in measures)).distinct()
    same = F.lit(True)
    for c in measures:
        same = same & (F.col(c).cast("double") == F.col(f"__{c}"))
    return rows.where(known).join(best, same, "left_semi").unionByName(rows.where(~known))


def paired_bootstrap(pairs: DataFrame, metric: str, left: str, right: str, id_col: str, samples: int = 2000, seed: int = 42, generator: str = "mt19937", levels: Sequence[float] = (0.95,)) -> DataFrame:
    """pairs(metric, id, left, right) -> (metric, n, difference, win_share, and low_L, high_L for each level L in thousandths) of
    right minus left, ids in order, by one of two fixed streams of random numbers.

    A metric is one task, of as many numbers as there are queries in an evaluation set; for tables use poisson_bootstrap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = (pdf.sort_values("__id")["__r"] - pdf.sort_values("__id")["__l"]).to_numpy()
        n = len(d)
        if generator == "pcg64":
            rng = np.random.default_rng(seed)
            means = np.concatenate([d[rng.integers(0, n, size=(min(256, samples - k), n))].mean(axis=1) for k in range(0, samples, 256)])
        else:
            draw = random.Random(seed)
            means = np.array([d[[draw.randrange(n) for _ in range(n)]].mean() for _ in range(samples)])
        ends = {f"{side}_{round(1000 * level)}": [np.quantile(means, (1 + sign * level) / 2)] for level in levels for side, sign in (("low", -1), ("high", 1))}
        return pd.DataFrame({"metric": [pdf["metric"].iloc[0]], "n": [n], "difference": [d.mean()], "win_share": [float((means > 0).mean())], **ends})

    rows = pairs.select(F.col(metric).alias("metric"), F.col(id_col).alias("__id"), F.col(left).cast("double").alias("__l"), F.col(right).cast("double").alias("__r")).where("__l is not null and __r is not null")
    ends = ", ".join(f"low_{round(1000 * x)} double, high_{round(1000 * x)} double" for x in levels)
    return rows.groupBy("metric").applyInPandas(run, f"metric string, n long, difference double, win_share double, {ends}")


def hashed_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 13 digits of their digest."""
    text = F.concat_ws(":", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_weight(u: Column) -> Column:
    """How often a row counts in a sample: Poisson(1) by a number in [0, 1)."""
    steps, cut, term = [], 0.0, 0.36787944117144233
    for k in range(1, 9):
        cut += term
        steps.append((cut, k))
        term /= k
    weight = F.lit(0)
    for cut, k in steps:
        weight = F.when(u >= cut, k).otherwise(weight)
    return weight


def poisson_bootstrap(pairs: DataFrame, metric: str, left: str, right: str, id_col: str, samples: int = 200, level: float = 0.95) -> DataFrame:
    """(metric, n, difference, low, high, win_share) of right minus left, for any number of queries: each query counts Poisson(1)
    times in each sample, by a digest of both. Sums combine before the shuffle, so that a metric makes `samples` rows. A sample
    in which no query counts is left out, and so is a pair with a null."""
    weight = poisson_weight(F.col("__u"))
    diffs = pairs.select(F.col(metric).alias("metric"), F.col(id_col).alias("__id"), (F.col(right).cast("double") - F.col(left).cast("double")).alias("__d")).where("__d is not null")
    drawn = diffs.select("*", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample")).withColumn("__u", hashed_uniform("__id", "sample"))
    means = drawn.groupBy("metric", "sample").agg(F.try_divide(F.sum(weight * F.col("__d")), F.sum(weight)).alias("mean")).where("mean is not null")
    ends = means.groupBy("metric").agg(F.percentile("mean", (1 - level) / 2).alias("low"), F.percentile("mean", (1 + level) / 2).alias("high"), F.avg((F.col("mean") > 0).cast("double")).alias("win_share"))
    whole = diffs.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("__d").alias("difference"))
    return whole.join(ends, "metric", "left")


def compare_all_arms(runs: DataFrame, arm: str, id_col: str, metrics: Sequence[str], comparisons: Sequence[tuple[str, str]], samples: int = 200, level: float = 0.95, contract: str | None = None) -> DataFrame:
    """runs(arm, id, metrics...) -> (comparison, metric, n, difference, low, high, win_share, state) for each (control, variant) of
    comparisons: variant minus control over ids that both have, by one bootstrap whose draws all comparisons and metrics share. state:
    statistically_separated if the interval leaves out 0, else inconclusive. Several rows of an id are averaged first. contract: a
    column that must be one value over the compared arms and never null; else it is an error.

    A draw is made once for an id and sample; sums combine before the shuffle, so that what moves is a row a sample."""
    arms = sorted({a for pair in comparisons for a in pair})
    used = runs.where(F.col(arm).isin(arms))
    if contract:
        row = used.agg(F.count_distinct(contract).alias("n"), F.count_if(F.col(contract).isNull()).alias("none")).first()
        if row["n"] > 1 or row["none"]:
            raise ValueError(f"arms differ in {contract}: {row['n']} values, {row['none']} rows without one")
    pick = lambda m, a: F.avg(F.when(F.col(arm) == a, F.col(m).cast("double")))
    wide = used.groupBy(F.col(id_col).alias("__id")).agg(*(pick(m, a).alias(f"v_{i}_{j}") for i, m in enumerate(metrics) for j, a in enumerate(arms)))
    place = {a: j for j, a in enumerate(arms)}
    keys = [(i, k) for i in range(len(metrics)) for k in range(len(comparisons))]
    diffs = wide.select("__id", *((F.col(f"v_{i}_{place[comparisons[k][1]]}") - F.col(f"v_{i}_{place[comparisons[k][0]]}")).alias(f"d_{i}_{k}") for i, k in keys))
    drawn = diffs.select("*", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample")).withColumn("__u", hashed_uniform("__id", "sample")).withColumn("w", poisson_weight(F.col("__u")))
    of = lambda i, k: F.try_divide(F.sum(F.col("w") * F.col(f"d_{i}_{k}")), F.sum(F.when(F.col(f"d_{i}_{k}").isNotNull(), F.col("w"))))
    means = drawn.groupBy("sample").agg(*(of(i, k).alias(f"d_{i}_{k}") for i, k in keys))
    name = lambda k: f"{comparisons[k][1]}_minus_{comparisons[k][0]}"
    long = lambda df, make: df.select(F.explode(F.array(*(make(i, k) for i, k in keys))).alias("x")).select("x.*")
    head = lambda i, k: (F.lit(name(k)).alias("comparison"), F.lit(metrics[i]).alias("metric"))
    each = long(means, lambda i, k: F.struct(*head(i, k), F.col(f"d_{i}_{k}").alias("mean"))).where("mean is not null")
    ends = each.groupBy("comparison", "metric").agg(F.percentile("mean", (1 - level) / 2).alias("low"), F.percentile("mean", (1 + level) / 2).alias("high"), F.avg((F.col("mean") > 0).cast("double")).alias("win_share"))
    totals = diffs.agg(*(F.count(f"d_{i}_{k}").alias(f"n_{i}_{k}") for i, k in keys), *(F.avg(f"d_{i}_{k}").alias(f"d_{i}_{k}") for i, k in keys))
    whole = long(totals, lambda i, k: F.struct(*head(i, k), F.col(f"n_{i}_{k}").alias("n"), F.col(f"d_{i}_{k}").alias("difference")))
    apart = F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False))
    return whole.join(ends, ["comparison", "metric"], "left").withColumn("state", F.when(apart, "statistically_separated").otherwise("inconclusive"))


def arm_verdicts(compared: DataFrame, primary: str, effect: float, margins: dict[str, float], least: int = 1) -> DataFrame:
    """compared (of compare_all_arms) -> (comparison, status, outcome, missing, worse): status by decision(): eligible if the primary
    metric's lower bound reaches `effect` and no guarded metric's falls below minus its margin. incomplete as well where a metric has
    fewer than `least` common ids. missing, worse: the metrics at fault, sorted. outcome: whether any metric is separated."""
    wanted = [primary, *margins]
    bound = lambda m: F.max(F.when((F.col("metric") == m) & (F.col("n") >= least), F.col("low")))
    g = compared.where(F.col("metric").isin(wanted)).groupBy("comparison").agg(*(bound(m).alias(f"low_{k}") for k, m in enumerate(wanted)), F.bool_or(F.col("state") == "statistically_separated").alias("any"))
    low = {m: F.col(f"low_{k}") for k, m in enumerate(wanted)}
    names = lambda tests: F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), m) for m, t in tests.items()))))
    return g.select(
        "comparison", decision(low[primary], effect, {m: (low[m], d) for m, d in margins.items()}).alias("status"), F.when(F.col("any"), "statistically_separated").otherwise("inconclusive").alias("outcome"),
        names({m: c.isNull() for m, c in low.items()}).alias("missing"), names({m: low[m] < -d for m, d in margins.items()}).alias("worse"),
    )


def sign_flip(pairs: DataFrame, metric: str, left: str, right: str, id_col: str, most: int = 20) -> DataFrame:
    """(metric, n, difference, p): exact one-sided test that right minus left is positive: the share of all 2^n choices of signs
    whose sum is at least the one seen. n is the number of paired runs, `most` at most: more are an error."""
    d = pairs.select(F.col(metric).alias("metric"), F.col(id_col).alias("__id"), (F.col(right).cast("double") - F.col(left).cast("double")).alias("__d")).where("__d is not null")
    held = d.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("__id", "__d"))).alias("x"))
    held = held.select("metric", F.when(F.size("x") <= most, F.transform("x", lambda v: v["__d"])).otherwise(F.raise_error(F.lit("too many pairs for an exact test"))).alias("d"))
    signed = lambda m: F.aggregate(F.transform("d", lambda v, i: F.when(F.getbit(m, i) == 1, -v).otherwise(v)), F.lit(0.0), lambda a, v: a + v)
    flips = held.select("metric", "d", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.size("d")).cast("long") - 1)).alias("m"))
    seen = F.aggregate("d", F.lit(0.0), lambda a, v: a + v)
    return flips.groupBy("metric").agg(F.first(F.size("d")).cast("long").alias("n"), F.first(seen / F.size("d")).alias("difference"), F.avg((signed(F.col("m")) >= seen - 1e-12).cast("double")).alias("p"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided p of wins against losses; ties are left out before; 1 without any."""
    n, k = (wins + losses).cast("double"), F.least(wins, losses).cast("int")
    start = F.struct((-n * float(np.log(2.0))).alias("log"), F.exp(-n * float(np.log(2.0))).alias("sum"))
    step = lambda a, i: F.struct((a["log"] + F.log((n - i + 1) / i)).alias("log"), (a["sum"] + F.exp(a["log"] + F.log((n - i + 1) / i))).alias("sum"))
    upto = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), 2 * F.aggregate(upto, start, step, lambda a: a["sum"]))


def detectable(sd: Column, n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """The least true difference that a two-sided paired test of n queries finds with such power."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.when(n > 0, z * sd / F.sqrt(n))


def spread(value: str) -> list[Column]:
    """n, mean, sample deviation (0 for one value), range."""
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_samp(value)).when(F.count(value) == 1, 0.0).alias("sd"), (F.max(value) - F.min(value)).alias("range")]


def index_quantile(rows: DataFrame, by: Sequence[str], value: str, p: float, ceil: bool = False) -> DataFrame:
    """(by..., quantile): the value at place floor(p (n - 1)), or with ceil at place ceil(p n) - 1, of the sorted values of each
    group. Equal values are counted together, and running counts go by ranges of groups and values, so that no task holds a group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    summed = running_sums(counts.withColumn("__key", F.struct(*by, value)), "__key", "__n", "__upto")
    groups = summed.groupBy(*(F.col(b).alias(f"__by_{k}") for k, b in enumerate(by))).agg(F.min(F.col("__upto") - F.col("__n")).alias("__from"), F.sum("__n").alias("__total"))
    n = F.col("__total")
    groups = groups.withColumn("__at", F.greatest(F.ceil(n * p) - 1, F.lit(0)) if ceil else F.floor((n - 1) * p))
    same = F.lit(True)
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by_{k}"))
    return summed.join(groups, same).where(F.col("__upto") - F.col("__from") > F.col("__at")).groupBy(*by).agg(F.min(value).alias("quantile"))


def rule_quality(gold: Column, predicted: Column) -> dict[str, Column]:
    """Of boolean columns: n, precision, recall, specificity, balanced_accuracy; null where undefined."""
    n = lambda c: F.sum(c.cast("long"))
    recall, specificity = F.try_divide(n(gold & predicted), n(gold)), F.try_divide(n(~gold & ~predicted), n(~gold))
    return {"n": F.count(F.lit(1)), "precision": F.try_divide(n(gold & predicted), n(predicted)), "recall": recall, "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2}


def best_of_group(left: DataFrame, right: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """One row (groups, left_wins, right_wins, ties): each side's best score of a group that both have."""
    best = lambda df, n: df.groupBy(*keys).agg(F.max(score).alias(n))
    both = best(left, "a").join(best(right, "b"), list(keys)).where("a is not null and b is not null")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(F.count(F.lit(1)).alias("groups"), count(F.col("a") > F.col("b")).alias("left_wins"), count(F.col("a") < F.col("b")).alias("right_wins"), count(F.col("a") == F.col("b")).alias("ties"))


def convergence(runs: DataFrame, arm: str, value: str, chance: float, times: float = 4.0, share: float = 0.5) -> DataFrame:
    """runs with `floor`, the greater of `times` chance and `share` of the arm's median, and `converged`: not below it."""
    floors = runs.groupBy(arm).agg(F.greatest(F.lit(times * chance), share * F.median(value)).alias("floor"))
    return runs.join(floors, arm).withColumn("converged", F.col(value) >= F.col("floor"))


def decision(low: Column, effect: float, margins: dict[str, tuple[Column, float]]) -> Column:
    """eligible: the effect's lower bound reaches it and no guarded lower bound falls below minus its margin; rejected: one
    does; non_inferior_only: the effect isn't shown; incomplete: a bound is null."""
    missing, worse = low.isNull(), F.lit(False)
    for bound, margin in margins.values():
        missing, worse = missing | bound.isNull(), worse | (bound < -margin)
    return F.when(missing, "incomplete").when(worse, "rejected").when(low >= effect, "eligible").otherwise("non_inferior_only")


def gates(rules: dict[str, tuple[Column, str, float]]) -> dict[str, Column]:
    """rule -> (value, 'higher' or 'lower', limit) as booleans, and `passed`: all hold; null values don't."""
    out = {k: F.coalesce(v >= t if kind == "higher" else v <= t, F.lit(False)) for k, (v, kind, t) in rules.items()}
    whole = F.lit(True)
    for c in out.values():
        whole = whole & c
    return out | {"passed": whole}


def contract_differences(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, differs): sorted names of the fields in which two sides differ, null-safe; keys on one side differ by `key`."""
    a = left.select(F.col(key).alias("__a"), *(F.col(f).alias(f"a_{f}") for f in fields))
    b = right.select(F.col(key).alias("__b"), *(F.col(f).alias(f"b_{f}") for f in fields))
    both = a.join(b, F.col("__a") == F.col("__b"), "full")
    names = F.array_compact(F.array(F.when(F.col("__a").isNull() | F.col("__b").isNull(), key), *(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in sorted(fields))))
    return both.select(F.coalesce("__a", "__b").alias(key), names.alias("differs")).where("size(differs) > 0")


def evidence(runs: DataFrame, arm: str, seed: str, metric: str, value: str, metrics: Sequence[str], seeds: int) -> DataFrame:
    """(arm, metric, n_seeds, mean, complete): means over seeds of every required metric; complete: all seeds have it."""
    arms = runs.select(arm).distinct().select(arm, F.explode(F.array(*map(F.lit, metrics))).alias(metric))
    found = runs.where(F.col(value).isNotNull()).groupBy(arm, metric).agg(F.count_distinct(seed).alias("n_seeds"), F.avg(value).alias("mean"))
    return arms.join(found, [arm, metric], "left").select(arm, metric, F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"), "mean", (F.coalesce("n_seeds", F.lit(0)) >= seeds).alias("complete"))


def kappa_by_raters(ratings: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """One row (raters, items, observed, kappa): Cohen's for two raters, Fleiss' for more, over items that all have rated."""
    raters = [r[0] for r in ratings.select(rater).where(F.col(rater).isNotNull()).distinct().orderBy(rater).collect()]  # people: few
    full = ratings.where(F.col(label).isNotNull()).groupBy(item).agg(F.count_distinct(rater).alias("__n")).where(F.col("__n") == len(raters)).select(item)
    complete = ratings.join(full, item, "left_semi")
    if len(raters) == 2:
        pick = lambda r: F.max(F.when(F.col(rater) == r, F.col(label)))
        return cohen_kappa(complete.groupBy(item).agg(pick(raters[0]).alias("a"), pick(raters[1]).alias("b")), "a", "b").select(F.lit(2).cast("long").alias("raters"), F.col("n").alias("items"), "observed", "kappa")
    return fleiss_kappa(complete, item, label, max(2, len(raters))).select(F.lit(len(raters)).cast("long").alias("raters"), "items", F.col("agreement").alias("observed"), "kappa")


def compare_arms(left: DataFrame, right: DataFrame, id_col: str, metrics: Sequence[str], samples: int = 200) -> DataFrame:
    """poisson_bootstrap of each metric over ids that both arms have, with `verdict`: better, worse or open, as the interval lies.
    Several rows of an id (candidates of a query) are averaged first."""
    mean = lambda df: df.groupBy(id_col).agg(*(F.avg(m).alias(m) for m in metrics))
    long = lambda df, n: mean(df).select(id_col, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(n)) for m in metrics))).alias("x")).select(id_col, "x.*")
    found = poisson_bootstrap(long(left, "l").join(long(right, "r"), [id_col, "metric"]), "metric", "l", "r", id_col, samples)
    return found.withColumn("verdict", F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("open"))
