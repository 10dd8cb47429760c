"""Audits of tables and of predictions: lengths, categories and rates, monotony of openings, coverage and calibration, difficulty,
repeated and conflicting ids, disagreements and actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .selection import hash_sample
from .statistics import distribution

NONE = "unknown"


def _slices(fields: Sequence[str]) -> Column:
    """(field, value) once for `all` and once for each slice field; null is 'unknown'."""
    own = (F.struct(F.lit(s).alias("field"), F.coalesce(F.col(s).cast("string"), F.lit(NONE)).alias("value")) for s in fields)
    return F.explode(F.array(F.struct(F.lit("all").alias("field"), F.lit("all").alias("value")), *own))


def data_audit(rows: DataFrame, lengths: dict[str, Column], categories: Sequence[str], rates: dict[str, Column]) -> DataFrame:
    """(section, name, value, n, mean, least, p05, ..., most): of each length its distribution (section length), of each category its values
    with their counts (section category, null as 'unknown'), of each rate n and mean over the rows that have it (section rate)."""
    number = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), c.cast("double").alias("v")) for k, c in lengths.items())))
    spread = rows.select(number.alias("x")).select("x.*").groupBy("name").agg(*distribution("v")).withColumn("section", F.lit("length"))
    label = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias("value")) for c in categories)))
    counts = rows.select(label.alias("x")).select("x.*").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit("category"))
    test = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), c.cast("int").cast("double").alias("v")) for k, c in rates.items())))
    shares = rows.select(test.alias("x")).select("x.*").groupBy("name").agg(F.count("v").alias("n"), F.avg("v").alias("mean")).withColumn("section", F.lit("rate"))
    out = spread.unionByName(counts, allowMissingColumns=True).unionByName(shares, allowMissingColumns=True)
    return out.select("section", "name", "value", "n", "mean", "least", "p05", "p25", "p50", "p75", "p95", "most")


def sampled_examples(rows: DataFrame, id_col: str, text_col: str, n: int, seed: str, chars: int = 300) -> DataFrame:
    """(id, shown): the n rows that come first in hash order, with the beginnings of their texts."""
    return hash_sample(rows.select(id_col, text_col), id_col, n, seed).select(id_col, F.left(F.col(text_col), F.lit(chars)).alias("shown"))


def monotony(rows: DataFrame, query: str, slices: Sequence[str] = ()) -> DataFrame:
    """(field, value, queries, without_words, distinct, top_1, top_3, top_5, entropy_nats, normalized_entropy) of the queries' first words, of all
    and by each value of each slice field. normalized_entropy is 1 where all first words are as frequent, 0 where there is one.

    First words are counted before anything is ranked, and only a slice's five first ones are."""
    first = rows.withColumn("__word", F.get(T.words(F.col(query)), 0))
    counts = first.select(_slices(slices).alias("s"), "__word").groupBy("s.field", "s.value", "__word").agg(F.count(F.lit(1)).alias("n"))
    word, total = F.col("__word").isNotNull(), F.sum(F.when(F.col("__word").isNotNull(), F.col("n")))
    whole = counts.groupBy("field", "value").agg(F.sum("n").alias("queries"), F.coalesce(F.sum(F.when(~word, F.col("n"))), F.lit(0)).alias("without_words"), F.count("__word").alias("distinct"), total.alias("__all"), F.sum(F.when(word, F.col("n") * F.ln("n"))).alias("__x"))
    order = Window.partitionBy("field", "value").orderBy(F.desc("n"), "__word")
    heads = counts.where(word).withColumn("__i", F.row_number().over(order)).where(F.col("__i") <= 5).groupBy("field", "value").agg(*(F.sum(F.when(F.col("__i") <= k, F.col("n"))).alias(f"__t{k}") for k in (1, 3, 5)))
    nats = F.ln("__all") - F.col("__x") / F.col("__all")
    both = whole.join(heads, ["field", "value"], "left").withColumn("entropy_nats", nats)
    level = F.when(F.col("distinct") > 1, F.col("entropy_nats") / F.ln("distinct")).when(F.col("distinct") == 1, 0.0)
    return both.select("field", "value", "queries", "without_words", "distinct", *((F.col(f"__t{k}") / F.col("__all")).alias(f"top_{k}") for k in (1, 3, 5)), "entropy_nats", level.alias("normalized_entropy"))


def covered_accuracy(rows: DataFrame, gold: str, predicted: str, by: Sequence[str] = (), confidence: str | None = None) -> DataFrame:
    """(by..., n, covered, coverage, accuracy, and with a confidence: mean_confidence, gap) of rows that have a gold label: a prediction that is
    null or 'unknown' abstains and isn't covered; accuracy, mean confidence and their distance are over covered rows, null without any."""
    known = rows.where(F.col(gold).isNotNull())
    sure = F.coalesce(F.col(predicted).cast("string") != NONE, F.lit(False))
    more = [F.avg(F.when(sure, F.col(confidence).cast("double"))).alias("mean_confidence")] if confidence else []
    found = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(sure).alias("covered"), F.avg(F.when(sure, (F.col(gold) == F.col(predicted)).cast("double"))).alias("accuracy"), *more)
    out = found.select(*by, "n", "covered", F.try_divide("covered", "n").alias("coverage"), "accuracy", *(["mean_confidence"] if confidence else []))
    return out.withColumn("gap", F.abs(F.col("mean_confidence") - F.col("accuracy"))) if confidence else out


def difficulty_report(rows: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(by..., n, the mean of each measure) of every combination, of every subset of the columns, and of all: null stands for all values, so
    that null values are shown as 'unknown'. One pass by grouping sets."""
    named = rows.select(*(F.coalesce(F.col(b).cast("string"), F.lit(NONE)).alias(b) for b in by), *(F.col(m).cast("double").alias(m) for m in measures))
    return named.cube(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in measures))


def occurrences(rows: DataFrame, key: str, value: Column, ordinal: str) -> DataFrame:
    """(key, occurrences, n_values, kept, state): how often an id stands, how many values it has, the first value by ordinal, and unique, repeated
    (with one value) or conflict. Null is a value."""
    digest = F.sha2(F.coalesce(value.cast("string"), F.lit("\0")), 256)
    g = rows.select(F.col(key), F.col(ordinal).alias("__o"), digest.alias("__h"), value.cast("string").alias("__v")).groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("__h").alias("n_values"), F.min_by("__v", F.struct("__o", "__h")).alias("kept"))
    return g.withColumn("state", F.when(F.col("n_values") > 1, "conflict").when(F.col("occurrences") > 1, "repeated").otherwise("unique"))


def disagreements(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a, b(key, rank, margin) -> (key, rank_a, rank_b, winner): shared keys on which the judges rank differently; winner: whether they differ
    in who wins as well."""
    both = a.select(key, F.col("rank").alias("rank_a")).join(b.select(key, F.col("rank").alias("rank_b")), key)
    return both.where("rank_a <> rank_b").withColumn("winner", (F.col("rank_a") == 1) != (F.col("rank_b") == 1))


def action_histogram(candidates: DataFrame, score: str) -> DataFrame:
    """candidates with `flagged` and `action` -> (action, n, scored, flagged, share, flagged_rate): flagged_rate is over scored ones."""
    counted = candidates.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("scored"), F.count_if(F.col("flagged") & F.col(score).isNotNull()).alias("flagged"))
    total = F.broadcast(counted.agg(F.sum("n").alias("__all")))  # one row
    return counted.join(total).select("action", "n", "scored", "flagged", (F.col("n") / F.col("__all")).alias("share"), F.try_divide("flagged", "scored").alias("flagged_rate"))
