"""How much of a passage a query repeats, what that is worth, and what is too much."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.statistics import pearson, running_sums
from . import text as T

#: Limits of copying: least words, share copied in a row, share in order, words in a row, length ratio.
COPY_LIMITS = {"words": 4, "density": 0.6, "lcs": 0.8, "ngram": 3, "length_ratio": 0.38388}


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.concatenate([np.asarray(a, object), np.asarray(b, object)]).astype(str), return_inverse=True)[1]
    return both[: len(a)], both[len(a) :]


@F.pandas_udf(StructType([StructField("longest", IntegerType()), StructField("lcs", IntegerType())]))
def common_runs(query: pd.Series, passage: pd.Series) -> pd.DataFrame:
    """Of two token arrays: the longest run of tokens that both hold, and the length of their longest common subsequence.

    A query of n tokens takes n steps over the passage's tokens as one array. Null counts as empty."""
    longest, lcs = [], []
    for q, p in zip(query, passage):
        if q is None or p is None or not len(q) or not len(p):
            longest.append(0)
            lcs.append(0)
            continue
        a, b = _numbered(q, p)
        run, row, most = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64), 0
        for x in a:
            same = b == x
            run = np.concatenate([[0], np.where(same, run[:-1] + 1, 0)])
            most = max(most, int(run.max()))
            row = np.maximum.accumulate(np.concatenate([[0], np.where(same, row[:-1] + 1, row[1:])]))
        longest.append(most)
        lcs.append(int(row[-1]))
    return pd.DataFrame({"longest": np.array(longest, np.int32), "lcs": np.array(lcs, np.int32)})


def preserved(query: Column, passage: Column) -> Column:
    """The share of what the query names that the passage names as well; 1 where it names nothing."""
    return T.share(F.array_intersect(query, passage), F.array_distinct(query), 1.0)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common elements by the smaller set; 0 where one is empty."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)


def overlap_measures(pairs: DataFrame, query: str, passage: str) -> DataFrame:
    """pairs with what a query has in common with its passage: content_jaccard, overlap_coefficient, query_precision,
    passage_recall, longest_copied, copy_density, lcs_share, number_preservation, unit_preservation, length_ratio."""
    toks = pairs.withColumns({"__q": T.tokens(F.col(query)), "__p": T.tokens(F.col(passage))})
    toks = toks.withColumns({"__a": F.array_distinct(T.content(F.col("__q"))), "__b": F.array_distinct(T.content(F.col("__p"))), "__c": common_runs("__q", "__p")})
    both, n = F.array_intersect("__a", "__b"), F.size("__q")
    by_n = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    return toks.withColumns({
        "content_jaccard": T.jaccard(F.col("__a"), F.col("__b")), "overlap_coefficient": overlap_coefficient(F.col("__a"), F.col("__b")), "query_precision": T.share(both, F.col("__a")), "passage_recall": T.share(both, F.col("__b")),
        "longest_copied": F.col("__c.longest"), "copy_density": by_n(F.col("__c.longest")), "lcs_share": by_n(F.col("__c.lcs")),
        "number_preservation": preserved(T.numbers(F.col("__q")), T.numbers(F.col("__p"))), "unit_preservation": preserved(T.units(F.col("__q")), T.units(F.col("__p"))),
        "word_length": n, "length_ratio": F.when(F.size("__p") > 0, n / F.size("__p")).otherwise(0.0),
    }).drop("__q", "__p", "__a", "__b", "__c")


def copy_risk(limits: dict[str, float] = COPY_LIMITS) -> Column:
    """Of rows with overlap_measures: long enough, and copied in a row and in order, or a longer run, or too long; all beyond,
    none at, its limit."""
    over = lambda c, k: F.col(c) > limits[k]
    return (F.col("word_length") >= limits["words"]) & ((over("copy_density", "density") & over("lcs_share", "lcs")) | over("longest_copied", "ngram") | over("length_ratio", "length_ratio"))


def natural_limits(rows: DataFrame, group: str, order: str, most: float = 0.95, ratio: float = 0.99) -> DataFrame:
    """One row (density, lcs, ngram, length_ratio): where copying by people ends, from each group's first row."""
    first = rows.withColumn("__i", F.row_number().over(Window.partitionBy(group).orderBy(order))).where("__i = 1")
    return first.agg(F.percentile("copy_density", most).alias("density"), F.percentile("lcs_share", most).alias("lcs"), F.percentile("longest_copied", most).alias("ngram"), F.percentile("length_ratio", ratio).alias("length_ratio"))


def residual_jaccard(a: Column, b: Column, passage: Column) -> Column:
    """Likeness of two queries' terms without those of their passage; 1 where nothing is left."""
    return T.jaccard(F.array_except(a, passage), F.array_except(b, passage), 1.0)


def grounding_reward(score: Column, margin: Column, weight: float = 0.5) -> Column:
    """Calibrated score and weighted calibrated margin."""
    return score + weight * margin


def right_percentile(rows: DataFrame, value: str, reference: DataFrame, of: str) -> DataFrame:
    """rows with `percentile`: the share of the reference's values that are at most the row's. Both are summed up by value
    first; running counts go by ranges of values, so that no task sees all."""
    known = reference.where(F.col(of).isNotNull()).groupBy(F.col(of).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    asked = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v")).distinct().withColumn("__n", F.lit(0).cast("long"))
    summed = running_sums(known.unionByName(asked).groupBy("__v").agg(F.sum("__n").alias("__n")), "__v", "__n", "__upto")
    total = F.broadcast(known.agg(F.sum("__n").alias("__all")))  # one row
    place = summed.join(total).select(F.col("__v"), (F.col("__upto") / F.col("__all")).alias("percentile"))
    return rows.withColumn("__v", F.col(value).cast("double")).join(place, "__v", "left").drop("__v")


def correlations(rows: DataFrame, names: Sequence[str], total: str | None = None, dominant: float = 0.95) -> DataFrame:
    """(left, right, r, dominates): Pearson's r of all pairs of columns, null where one doesn't vary; dominates: one of the two is
    the total and |r| reaches `dominant`. One pass."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    found = rows.agg(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), pearson(a, b).alias("r")) for a, b in pairs)).alias("p"))
    out = found.select(F.explode("p").alias("p")).select("p.*")
    return out.withColumn("dominates", F.coalesce((F.abs("r") >= dominant) & (F.lit(total).isin(F.col("left"), F.col("right")) if total else F.lit(False)), F.lit(False)))


def balanced_weights(rows: DataFrame, label: str, low: float = 0.5, high: float = 2.0, steps: int = 80) -> DataFrame:
    """rows with `weight`: inverse to how frequent the label is, within bounds, with mean 1 over all rows.

    The driver sees a count for each label and finds the scale by halving; labels are a closed set. Null is a label."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    raw = {k: n / (len(counts) * c) for k, c in counts.items()}
    mean = lambda s: sum(c * min(high, max(low, s * raw[k])) for k, c in counts.items()) / max(1, n)
    lo, hi = 0.0, high / min(raw.values(), default=1.0)
    for _ in range(steps):
        lo, hi = ((lo + hi) / 2, hi) if mean((lo + hi) / 2) < 1 else (lo, (lo + hi) / 2)
    weight = F.lit(None).cast("double")
    for k, r in raw.items():
        weight = F.when(F.col(label).eqNullSafe(F.lit(k)), F.lit(min(high, max(low, hi * r)))).otherwise(weight)
    return rows.withColumn("weight", weight)


def preference_loss(chosen: Column, rejected: Column, reference_chosen: Column, reference_rejected: Column, beta: float) -> Column:
    """-log sigmoid(beta * advantage) of log-probabilities, the advantage being how much more than the reference the policy prefers the
    chosen side; computed so that neither end overflows. A log-probability that isn't finite is an error, null gives null."""
    if not beta > 0 or beta == float("inf"):
        raise ValueError(f"beta must be positive and finite: {beta}")
    x = -beta * ((chosen - rejected) - (reference_chosen - reference_rejected)).cast("double")
    finite = F.abs(x) < float("inf")
    loss = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(finite, loss).otherwise(F.raise_error(F.lit("log-probabilities must be finite")))


def weighted_loss(rows: DataFrame, losses: str, mask: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """rows(losses: array of a loss a token, mask: array of whether it counts, weight) -> (by..., examples, weight, loss): the mean over an
    example's counting tokens (0 without any), then the mean over examples by weight. Null weights count as 0."""
    counted = F.filter(F.arrays_zip(F.col(losses).alias("l"), F.col(mask).alias("m")), lambda x: F.coalesce(x["m"].cast("boolean"), F.lit(False)))
    mean = F.aggregate(counted, F.lit(0.0), lambda s, x: s + x["l"].cast("double")) / F.greatest(F.size(counted), F.lit(1))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    found = rows.select(*by, mean.alias("__m"), w.alias("__w")).groupBy(*by).agg(F.count(F.lit(1)).alias("examples"), F.sum("__w").alias("weight"), F.sum(F.col("__m") * F.col("__w")).alias("__s"))
    return found.select(*by, "examples", "weight", (F.col("__s") / F.greatest(F.col("weight"), F.lit(2.0**-23))).alias("loss"))
