"""Comparisons of arms, slots and variants, guards that two sides hold the same, and a cache of analyses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import records_digest
from .statistics import compare_arms, running_sums
from .tables import written


def same_cohort(left: DataFrame, right: DataFrame, key: str) -> None:
    """An error unless both sides have the same keys."""
    for a, b, side in ((left, right, "right"), (right, left, "left")):
        if row := a.select(key).join(b.select(key), key, "left_anti").limit(1).first():
            raise ValueError(f"{row[0]!r} is missing on the {side}")


def arm_summary(rows: DataFrame, arm: str, metrics: Sequence[str]) -> DataFrame:
    """(arm, n, the mean of each metric over the rows that have it)."""
    return rows.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in metrics))


def matched_arms(left: DataFrame, right: DataFrame, key: str, metrics: Sequence[str], samples: int = 200) -> DataFrame:
    """compare_arms of two arms that must have the same keys."""
    same_cohort(left, right, key)
    return compare_arms(left, right, key, metrics, samples)


def common_clean_groups(arms: Sequence[DataFrame], group: str, risk: str) -> DataFrame:
    """(group): groups that every arm has and in which no arm has a risk."""
    clean = [a.groupBy(group).agg(F.max(F.coalesce(F.col(risk), F.lit(True))).alias("r")).where("not r").select(group) for a in arms]
    out = clean[0]
    for c in clean[1:]:
        out = out.join(c, group, "left_semi")
    return out


def slot_contrasts(rows: DataFrame, group: str, slot: str, value: str) -> DataFrame:
    """(group, slots, best_slot, best, lead): the slot with the greatest value of each group, the first of equals, and by how much it
    leads the next one; null where it is alone."""
    ranked = F.reverse(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.col(slot)).alias("s"))))))
    g = rows.groupBy(group).agg(ranked.alias("r")).where("size(r) > 0")
    return g.select(group, F.size("r").alias("slots"), (-F.get("r", 0)["s"]).alias("best_slot"), F.get("r", 0)["v"].alias("best"), (F.get("r", 0)["v"] - F.get("r", 1)["v"]).alias("lead"))


def variant_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, match, mismatch, abstain_a, abstain_b, abstain_both) of two labels that may abstain with null."""
    x, y = F.col(a), F.col(b)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), count(F.coalesce(x == y, F.lit(False))).alias("match"), count(F.coalesce(x != y, F.lit(False))).alias("mismatch"),
        count(x.isNull() & y.isNotNull()).alias("abstain_a"), count(x.isNotNull() & y.isNull()).alias("abstain_b"), count(x.isNull() & y.isNull()).alias("abstain_both"),
    )


def complete_scored_groups(rows: DataFrame, scores: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """rows with their scores(item, ...), of the groups that have exactly k items, each scored."""
    both = rows.join(scores, item, "left")
    measures = [c for c in scores.columns if c != item]
    missing = F.lit(False)
    for m in measures:
        missing = missing | F.col(m).isNull()
    full = both.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.max(missing).alias("__m")).where((F.col("__n") == k) & ~F.col("__m")).select(group)
    return both.join(full, group, "left_semi")


def margin_scales(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, scale): the distance of the quartiles of each group's values, by linear interpolation; null where they meet or there are no values.

    Different values are counted and ranked over ranges of (by, value), so that no group is one task's."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.struct(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    upto = written(running_sums(counted, "k", "n", "upto").select("k.g", "k.v", "upto", (F.col("upto") - F.col("n")).alias("from")), "upto")
    groups = upto.groupBy("g").agg(F.min("from").alias("first"), F.max("upto").alias("end")).withColumnRenamed("g", "h")
    placed = upto.join(groups, F.col("g").eqNullSafe(F.col("h")))
    at = {p: p * (F.col("end") - F.col("first") - 1) for p in (0.25, 0.75)}
    held = lambda place: F.max(F.when((F.col("first") + place >= F.col("from")) & (F.col("first") + place < F.col("upto")), F.col("v")))
    found = placed.groupBy("h").agg(*(held(cut(x)).alias(f"{name}{int(100 * p)}") for p, x in at.items() for name, cut in (("low", F.floor), ("top", F.ceil))), *(F.max(x).alias(f"at{int(100 * p)}") for p, x in at.items()))

    def quartile(p: int) -> Column:
        low, top, x = F.col(f"low{p}"), F.col(f"top{p}"), F.col(f"at{p}")
        return F.when(low == top, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * top)

    iqr = quartile(75) - quartile(25)
    scales = found.select("h", F.when(iqr > 0, iqr).alias("scale"))
    return rows.select(by).distinct().join(scales, F.col(by).eqNullSafe(F.col("h")), "left").select(by, "scale")


def fingerprint_drift(frames: dict[str, DataFrame], columns: list[str]) -> list[str]:
    """The sorted names of the frames whose rows, as a set, aren't those of the first."""
    found = {n: tuple(records_digest(df, columns).first()) for n, df in frames.items()}
    first = next(iter(found.values()))
    return sorted(n for n, x in found.items() if x != first)


def cached_analysis(texts: DataFrame, cache: str, namespace: str, analyse: Callable[[Column], Column], kind: str) -> DataFrame:
    """texts(text) -> (content, analysis) of the different texts. The cache is a table (namespace, content, analysis) in a folder that
    driver and executors share; only texts whose digest it lacks are analysed, and appended."""
    from pyspark.sql.utils import AnalysisException

    spark, schema = texts.sparkSession, f"namespace string, content string, analysis {kind}"
    try:
        known = spark.read.schema(schema).parquet(cache).where(F.col("namespace") == namespace).select("content")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], "content string")
    each = texts.where("text is not null").select(F.sha2("text", 256).alias("content"), "text").dropDuplicates(["content"])
    new = each.join(known, "content", "left_anti").select(F.lit(namespace).alias("namespace"), "content", analyse(F.col("text")).cast(kind).alias("analysis"))
    new.write.mode("append").parquet(cache)
    found = spark.read.schema(schema).parquet(cache).where(F.col("namespace") == namespace).dropDuplicates(["content"])
    return found.join(each.select("content"), "content", "left_semi").select("content", "analysis")


def profile_flags(format_valid: Column, empty: Column, margin: Column, risky: Column, focus: Column) -> dict[str, Column]:
    """Of a candidate: admissible form, a proxy of being answerable, fit to be chosen, defective; focus is a score or null."""
    admissible = F.coalesce(format_valid & ~empty, F.lit(False))
    answerable = F.coalesce(margin > 0, F.lit(False))
    focused = F.coalesce(focus > 0, F.lit(True))
    clean = admissible & answerable & ~F.coalesce(risky, F.lit(False)) & focused
    return {"admissible": admissible, "answerable": answerable, "clean": clean, "defective": admissible & ~clean}
