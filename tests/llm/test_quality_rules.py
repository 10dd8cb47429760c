"""Features by plain Python, exact binomial tails, cutoffs by brute force, and odd rows."""

import math
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_rules as Q

RISK = Q.RISK / len(Q.RULES)
SPACE = "\x20\x09-\x0d"


def features(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_features(docs, odd, spark):
    extra = spark.createDataFrame([(900, "a b c a b c a b"), (901, "x x x x"), (902, "a\nb\n\n a\na\n"), (903, "    w\x1cx"), (904, "a a a"), (905, "\U0001f600<|>" * 3)], "doc_id long, text string")
    for df in (docs, odd, extra):
        got = Q.with_features(df.select("doc_id", "text")).collect()
        for r in got:
            assert tuple(r[c] for c in (*Q.FEATURES, "__lines")) == features(r["text"]), r["doc_id"]
        assert len(got) == df.count()


@pytest.mark.parametrize("k,n", [(0, 1), (0, 400), (3, 1000), (12, 1000), (100, 10_000), (13, 1000), (110, 10_000)])
def test_binomial_tail(spark, k, n):
    got = spark.range(1).select(Q.binomial_tail(F.lit(k), F.lit(n), RISK)).first()[0]
    p = Fraction(RISK).limit_denominator(10_000)
    a, b = p.numerator, p.denominator  # in whole numbers: no rounding
    want = float(Fraction(sum(math.comb(n, i) * a**i * (b - a) ** (n - i) for i in range(k + 1)), b**n)) if k <= n * RISK else 1.0
    assert math.isclose(got, want, rel_tol=1e-9)


def brute_cutoffs(rows, rules, risk, delta, strata):
    """rows [(stratum, good, base_failed, measures)]"""
    tests, found = sum(len(c) for _, c in rules.values()) * len(strata), {}
    for s in strata:
        mine = [(g, m) for t, g, failed, m in rows if t == s and not failed]
        n = sum(g for g, _ in mine)
        for rule, (_, cutoffs) in rules.items():
            best = None
            for i, c in enumerate(cutoffs):
                k, bad = (sum(g == want and m[rule] > c for g, m in mine) for want in (True, False))
                tail = sum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1)) if n and k <= n * risk else 1
                if bad and n and tail <= delta / tests and (best is None or (bad, -i) > best[0]):
                    best = ((bad, -i), c)
            if best:
                found[rule, s] = best[1]
    return found


def test_cutoffs_and_verdicts(spark):
    """Planted: texts full of symbols are bad in one language; in the other there are too few good ones for any certificate."""
    good, bad = " ".join(f"word{i}" for i in range(60)), " ".join(f"w#{i}$$" for i in range(60))
    rows = [(i, good + f" end{i}", "en") for i in range(400)] + [(1000 + i, bad + f" x{i}", "en") for i in range(30)] + [(2000 + i, good, "de") for i in range(5)] + [(3000 + i, bad, "de") for i in range(5)] + [(4000, bad, None), (4001, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("text").contains("$$"), 0).otherwise(1).alias("quality")).where("doc_id < 4000").union(spark.createDataFrame([(1, None), (None, 1), (7, 1)], "doc_id long, quality int"))
    v = Q.Verdicts(docs, labels, risk=0.2, carry=True)
    measured = []
    for i, t, lang in {(lang, t): (i, t, lang) for i, t, lang in rows if i < 4000}.values():
        w, chars, sym, dup, rep, lines = features(t)
        m = {"symbol_ratio": sym / w if w else 0, "repeat_ratio": rep / w if w else 0, "dup_line_ratio": dup / lines if lines else 0, "word_length": chars / w if w else 0}
        if i < 4000:
            measured.append((lang, "$$" not in t, w < 50 or 2 * rep > w, m))
    assert {(r, s): c for r, s, c in v.cutoffs} == brute_cutoffs(measured, Q.RULES, 0.05, Q.DELTA, ["en", "de"]) and v.cutoffs and all(s == "en" for _, s, _ in v.cutoffs)
    kept = {r["doc_id"]: r["kept"] for r in v.report().collect()}
    assert all(kept[i] == (i < 1000 or 2000 <= i < 4001) for i, *_ in rows)
    assert sorted(r["doc_id"] for r in v.keep().collect()) == sorted(i for i, k in kept.items() if k)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (None, None)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0)):
        v = Q.Verdicts(odd, lab, carry=True)
        assert v.report().count() == odd.count() and v.cutoffs == []
        kept = v.keep()
        assert kept.columns == odd.columns and kept.count() == 0  # too short, or one sentence over and over
    empty = Q.Verdicts(odd.limit(0), labels, carry=True)
    assert empty.report().count() == 0 == empty.keep().count()


def test_clashing_digests(spark, docs):
    """Windows that share a digest are told apart by their words."""
    got = Q.with_features(docs.select("doc_id", "text"), digest=lambda *w: F.length(w[0]).cast("long")).collect()
    for r in got:
        assert r["n_repeat_words"] == features(r["text"])[4]


def test_strata_and_copies(spark):
    """A null stratum has its own cutoffs, an unlabelled one has none, and copies of a text are one trial."""
    good, bad = " ".join(f"word{i}" for i in range(60)), " ".join(f"w#{i}$$" for i in range(60))
    rows = [(i, f"{good} end{i}", None) for i in range(400)] + [(1000 + i, f"{bad} x{i}", None) for i in range(20)] + [(2000, bad, "xx")]
    rows += [(3000 + i, good, "de") for i in range(900)] + [(5000 + i, bad, "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id <> 2000").select("doc_id", F.when(F.col("text").contains("$$"), 0).otherwise(1).alias("quality"))
    v = Q.Verdicts(docs, labels, risk=0.2)
    assert v.cutoffs and {s for _, s, _ in v.cutoffs} == {None}
    kept = {r["doc_id"]: r["kept"] for r in v.report().collect()}
    assert not kept[1000] and kept[2000] and kept[5000]
