"""Quality rules with risk-controlled thresholds.

Each rule rejects texts on one side of a cutoff. Which cutoff holds in a stratum (a language) is learned from labelled
holdouts: of the different labelled good texts of the stratum that the base rules let through, n in all, a cutoff would falsely
reject k. The exact binomial tail P(X <= k | n, risk) tests that the true false rejection rate exceeds the rule's risk; a cutoff
is certified if the tail is at most DELTA divided by the number of tests in all (Bonferroni over strata, rules and cutoffs). So
with probability 1 - DELTA no certified cutoff in any stratum rejects more than the rule's risk of its good texts, and as the
rules share RISK evenly, all together reject at most RISK of them. Of a rule's certified cutoffs that with the most rejections
of labelled bad texts holds, the mildest of equals; a rule without one rejects nothing.

Every value of the stratum column is a stratum, null too; a stratum without certificates has only the base rules. Features and
verdicts are columns of the row itself; the labelled counts are gathered, and the cutoffs that hold, at most one for each
labelled stratum and rule.

Nulls: a null text has no words (and fails the base rule), null labels are left out. A text that is labelled several times,
under one id or in copies, is one trial, good if any of its labels says so. Repeated rows each get their verdict. Extra columns
pass through Verdicts.keep, whatever they are called. An empty table has no verdicts; without labels only the base rules reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Risk of a false rejection by all rules together, and the chance that any certified cutoff exceeds its share.
RISK, DELTA = 0.05, 0.05
#: Rule -> (side on which it rejects, cutoffs from mild to strict).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbol_ratio": (">", (1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "repeat_ratio": (">", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "dup_line_ratio": (">", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "word_length": (">", (20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.0, 7.0)),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _length_without(text: Column, drop: str) -> Column:
    return F.length(F.translate(text, drop, ""))


def with_features(docs: DataFrame, text_col: str = "text", digest=F.xxhash64) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and __lines, lines that hold a word.

    n_repeat_words: words within a three-word window that the text holds twice or more. The windows' 64-bit digests are
    sorted with their places, so that a text of n words takes n log n steps; equal digests are verified by the words, and
    a text in which two different windows have one digest is sorted by the windows themselves."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: _length_without(x, SPACE) > 0)
    out = docs.withColumns({"__words": words, "__full": lines, "__n_symbols": (F.length(text) - _length_without(text, SYMBOLS)).cast("long"), "word_chars": _length_without(text, SPACE).cast("long")})
    places = F.sequence(F.lit(0), F.size("__words") - 3)
    window = lambda i: [F.get("__words", i + k) for k in range(3)]
    out = out.withColumn("__windows", F.when(F.size("__words") >= 4, F.array_sort(F.transform(places, lambda i: F.struct(digest(*window(i)).alias("h"), i.alias("i"))))))

    def twice(windows: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(windows, i)["h"], F.lit(False))
        return F.filter(windows, lambda x, i: same(x, i - 1) | same(x, i + 1))

    out = out.withColumn("__twice", twice(F.col("__windows")))
    at = lambda i: F.get("__twice", i)
    differ = lambda a, b: F.concat_ws(" ", *window(a["i"])) != F.concat_ws(" ", *window(b["i"]))
    clash = F.exists(F.sequence(F.lit(1), F.size("__twice") - 1), lambda i: (at(i)["h"] == at(i - 1)["h"]) & differ(at(i), at(i - 1)))
    spelled = F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("h"), i.alias("i"))))
    order = lambda windows: F.array_sort(F.transform(windows, lambda x: x["i"]))
    out = out.withColumn("__spelled", F.when((F.size("__twice") >= 2) & clash, spelled))
    out = out.withColumn("__again", F.when(F.col("__spelled").isNull(), order(F.col("__twice"))).otherwise(order(twice(F.col("__spelled")))))
    covered = F.aggregate("__again", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    found = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        "word_chars",
        F.col("__n_symbols").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__full").cast("long").alias("__lines"),
    )
    # the generator keeps later filters above it: pushed below, they would have the arrays made again for every use
    return out.withColumn("__found", F.explode(F.array(found))).select(*docs.columns, "__found.*")


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """What the rules compare, from the features; 0 for a text without words."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_ratio": ratio("n_symbols", "n_words"), "repeat_ratio": ratio("n_repeat_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "__lines"), "word_length": ratio("word_chars", "n_words")}


def _log_gamma(x: Column) -> Column:
    """Of x >= 1: Stirling's series at x + 8, then down by the recurrence."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    falls = F.lit(0.0)
    for i in range(8):
        falls = falls + F.log(x + float(i))
    return series - falls


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), for k <= n p; 1 beyond. From the largest term down, until terms are below 1e-17 of it."""
    k, n, odds = k.cast("double"), n.cast("double"), p / (1 - p)
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, 60 * F.sqrt(n * p + 1) + 100).cast("int")
    falling = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (k - i) / ((n - k + i + 1) * odds)).alias("term"), (a["sum"] + a["term"] * (k - i) / ((n - k + i + 1) * odds)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * falling))


def fit_cutoffs(labelled: DataFrame, rules=RULES, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """labelled(__stratum, good boolean, features...), a row for each different text -> (__stratum, rule, cutoff): the cutoffs
    that hold. risk: of all rules together; delta: over all strata that have labels."""
    strata, risk = labelled.select("__stratum").distinct().count(), risk / len(rules)
    passed = labelled.where(~base_failed()).select("__stratum", "good", *(c.alias(m) for m, c in measures().items()))
    tests = [(rule, side, i, t) for rule, (side, cutoffs) in rules.items() for i, t in enumerate(cutoffs)]
    count = lambda hit: F.coalesce(F.sum(hit.cast("long")), F.lit(0))
    each = [
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("strictness"), F.lit(t).alias("cutoff"), count(F.col("good") & _beyond(F.col(rule), side, t)).alias("k"), count(~F.col("good") & _beyond(F.col(rule), side, t)).alias("bad"))
        for rule, side, i, t in tests
    ]
    counts = passed.groupBy("__stratum").agg(count(F.col("good")).alias("n"), F.array(*each).alias("tests"))
    long = counts.select("__stratum", "n", F.explode("tests").alias("t")).select("__stratum", "n", "t.*")
    certified = long.where((F.col("bad") > 0) & (F.col("n") > 0) & (binomial_tail(F.col("k"), F.col("n"), risk) <= delta / (max(1, strata) * len(tests))))
    return certified.groupBy("__stratum", "rule").agg(F.max_by("cutoff", F.struct("bad", -F.col("strictness"))).alias("cutoff"))


def _beyond(value: Column, side: str, cutoff: float) -> Column:
    return value > cutoff if side == ">" else value < cutoff


class Verdicts:
    """Cutoffs learned from docs(id_col, text_col, stratum_col) and labels(id_col, quality_col 0 or 1).

    measured: a written table of all rows, (__id, __value the stratum's value, __row where carry is set, features)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", quality_col: str = "quality", rules=RULES, risk: float = RISK, delta: float = DELTA, carry: bool = False) -> None:
        """carry: docs' rows are written with their features, for keep() without a second pass over the texts."""
        self.rules, self.id_col = rules, id_col
        rows = docs.select(F.col(id_col).alias("__id"), F.col(stratum_col).alias("__value"), F.col(text_col).alias("__text"), *([F.struct("*").alias("__row")] if carry else []))
        found = with_features(rows, "__text").withColumn("__content", F.xxhash64("__text", F.octet_length("__text")))
        self.measured = written(found.drop("__text"), "quality-features")
        good = labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(quality_col) == 1).alias("good"))
        labelled = self.measured.drop("__row").join(good, "__id").withColumn("__stratum", F.struct("__value"))
        texts = labelled.groupBy("__stratum", "__content", *FEATURES, "__lines").agg(F.max("good").alias("good"))
        fitted = fit_cutoffs(texts, rules, risk, delta).collect()  # at most labelled strata x rules
        self.cutoffs = sorted(((r["rule"], r["__stratum"][0], r["cutoff"]) for r in fitted), key=str)

    def kept(self, value_col: str) -> Column:
        """Of rows with features: neither the base rules nor a cutoff of the row's stratum reject it."""
        values, rejected = measures(), base_failed()
        for rule, value, cutoff in self.cutoffs:
            rejected = rejected | (F.col(value_col).eqNullSafe(F.lit(value)) & _beyond(values[rule], self.rules[rule][0], cutoff))
        return ~rejected

    def report(self) -> DataFrame:
        """One row per row of docs: (id_col, features, base_failed, kept)."""
        return self.measured.select(F.col("__id").alias(self.id_col), *FEATURES, base_failed().alias("base_failed"), self.kept("__value").alias("kept"))

    def keep(self) -> DataFrame:
        """The rows of docs that are kept, with all their columns and no others; docs must be carried."""
        return self.measured.where(self.kept("__value")).select("__row.*")
