"""Validation of canonical records with a policy of warn, drop or error for each rule.

A record is (example_id, query, positives array<struct<doc_id, text>>, hard_negatives likewise, language)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Patterns of the text rules.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
HTML = r"<[ \t\n\r\f]*(?:html|body|div|p|script|style|br|table|a)(?:[^\p{L}\p{N}_]|$)"
LESS, GREATER = "&(?:lt|LT|#0*60|#[xX]0*3[cC]);?", "&(?:gt|GT|#0*62|#[xX]0*3[eE]);?"
BOILERPLATE = r"(?:cookie|polityka prywatności|wszelkie prawa zastrzeżone)"
MOJIBAKE = ("Ã", "Â", "Ë", "�")
#: Thresholds.
DEFAULTS = {"min_negatives": 10, "min_chars": 10, "max_chars": 20000, "high_overlap": 0.85, "least_language": 0.05}
#: Rules that aren't a mere warning by default.
MODES = {"missing_id": "drop", "empty_query": "drop", "invalid_documents": "drop", "too_few_positives": "drop", "too_few_negatives": "drop", "duplicate_doc_id": "drop", "positive_negative_overlap": "drop", "empty_document": "drop", "duplicate_example_id": "drop", "malformed_json": "drop"}


def text_flags(text: Column, low: int = DEFAULTS["min_chars"], high: int = DEFAULTS["max_chars"]) -> dict[str, Column]:
    """The rules of one text. References to < and >, by name or number, are decoded before the HTML rule; those to letters aren't."""
    n = F.length(F.btrim(text, F.lit(" \t\n\r\f")))
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, LESS, "<"), GREATER, ">"))
    return {
        "empty_document": n == 0, "short_text": n < low, "long_text": n > high, "control_characters": text.rlike(CONTROL), "html": plain.rlike(HTML),
        "boilerplate": F.lower(text).rlike(BOILERPLATE), "possible_mojibake": text.contains(MOJIBAKE[0]) | text.contains(MOJIBAKE[1]) | text.contains(MOJIBAKE[2]) | text.contains(MOJIBAKE[3]),
    }


def issues(records: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """records with `issues`: the sorted distinct rules that each breaks. A record with broken documents breaks only rules up to that one."""
    p = DEFAULTS | (thresholds or {})
    query = F.coalesce(F.col("query"), F.lit(""))
    pos, neg = F.col("positives"), F.col("hard_negatives")
    docs = F.concat(pos, neg)
    ids = F.transform(docs, lambda d: d["doc_id"])
    id_of = lambda a: F.transform(a, lambda d: d["doc_id"])
    broken = lambda a: a.isNull() | F.exists(a, lambda d: d["doc_id"].isNull() | (F.btrim(d["doc_id"]) == "") | d["text"].isNull())
    forms = F.array_distinct(F.transform(docs, lambda d: F.struct(T.normal_form(d["text"]).alias("form"), d["doc_id"].alias("doc_id"))))
    query_words = T.long_words(query)
    early = {"missing_id": F.btrim(F.coalesce(F.col("example_id"), F.lit(""))) == "", "empty_query": T.squeezed(query) == "", "invalid_documents": broken(pos) | broken(neg)}
    late = {
        "too_few_positives": F.size(pos) < 1,
        "too_few_negatives": F.size(neg) < p["min_negatives"],
        "duplicate_doc_id": F.size(ids) > F.size(F.array_distinct(ids)),
        "positive_negative_overlap": F.arrays_overlap(id_of(pos), id_of(neg)),
        "same_text_different_ids": F.size(forms) > F.size(F.array_distinct(F.transform(forms, lambda f: f["form"]))),
        "high_query_passage_overlap": F.exists(pos, lambda d: T.share(F.array_intersect(query_words, T.long_words(d["text"])), query_words) >= p["high_overlap"]),
        "likely_non_polish": (F.col("language") == "pl") & (F.size(T.words(query)) >= 5) & (T.language_share(T.words(query), T.POLISH_COMMON, T.POLISH_LETTERS) < p["least_language"]),
    }
    on_query = text_flags(query, p["min_chars"], p["max_chars"])
    flagged = lambda rule: lambda d: text_flags(d["text"], p["min_chars"], p["max_chars"])[rule]
    for rule in on_query:
        hit = F.exists(docs, flagged(rule))
        late[rule] = hit if rule in ("empty_document", "short_text") else hit | on_query[rule]
    flag = lambda rules: F.array(*(F.when(test, F.lit(rule)) for rule, test in rules.items()))
    found = F.when(early["invalid_documents"], flag(early)).otherwise(F.concat(flag(early), flag(late)))
    return records.withColumn("issues", F.array_sort(F.array_distinct(F.array_compact(found))))


def routed(records: DataFrame, modes: dict[str, str] | None = None, ordinal: str | None = None) -> DataFrame:
    """records with issues and `route`: accepted, rejected or error. With an ordinal column, later records of an id are rejected."""
    modes = MODES | (modes or {})
    out = issues(records)
    if ordinal:
        later = F.row_number().over(Window.partitionBy("example_id").orderBy(ordinal)) > 1
        out = out.withColumn("issues", F.when(later, F.array_sort(F.array_append("issues", F.lit("duplicate_example_id")))).otherwise(F.col("issues")))
    names = {m: [r for r, x in modes.items() if x == m] for m in ("error", "drop")}
    hit = lambda mode: F.exists("issues", lambda r: r.isin(names[mode])) if names[mode] else F.lit(False)
    return out.withColumn("route", F.when(hit("error"), "error").when(hit("drop"), "rejected").otherwise("accepted"))


def rule_counts(routed_records: DataFrame) -> DataFrame:
    """(rule, n): records that break each rule."""
    return routed_records.select(F.explode("issues").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def mode_counts(routed_records: DataFrame, modes: dict[str, str] | None = None) -> DataFrame:
    """(mode, records, issues): of each mode the records that break a rule of it, and how often."""
    modes = MODES | (modes or {})
    mode = F.coalesce(F.create_map(*(F.lit(x) for kv in modes.items() for x in kv))[F.col("rule")], F.lit("warn"))
    each = routed_records.select("example_id", F.explode("issues").alias("rule")).select("example_id", mode.alias("mode"))
    return each.groupBy("mode").agg(F.count_distinct("example_id").alias("records"), F.count(F.lit(1)).alias("issues"))


def first_examples(routed_records: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The first n records with an issue, by the order column."""
    return routed_records.where(F.size("issues") > 0).orderBy(order).limit(n)


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_values): keys under which different values stand."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(problem, key): ids missing on the right, orphans on the right, duplicates on either side."""
    named = lambda df, what: df.select(F.lit(what).alias("problem"), F.col(key))
    twice = lambda df: df.groupBy(key).count().where("count > 1").select(key)
    return (
        named(left.select(key).distinct().join(right, key, "left_anti"), "missing")
        .unionByName(named(right.select(key).distinct().join(left, key, "left_anti"), "orphan"))
        .unionByName(named(twice(left), "duplicate_left"))
        .unionByName(named(twice(right), "duplicate_right"))
    )
