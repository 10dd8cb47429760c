"""Spelling variants against pairwise comparison."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import registry
from millrace.llm.spelling import deletion_keys, spelling_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    masks, at = {}, {}
    for w in n:  # a word with one place open, at that place
        for k in range(len(w)):
            masks.setdefault((k, w[:k], w[k + 1 :]), set()).add(w)
    for w in n:
        at[w] = {o for k in range(len(w)) for o in masks[k, w[:k], w[k + 1 :]] if o != w}
        at[w] |= {w[:k] + w[k + 1 :] for k in range(len(w)) if w[:k] + w[k + 1 :] in n}
    for w in n:
        for o in list(at[w]):
            at[o].add(w)
    form = {w: best for w in n if at[w] for best in [min(at[w], key=lambda o: (-n[o], o))] if n[best] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(at[w]), n.get(form.get(w))) for w in n)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], "doc_id long, text string, word string, id int, n int, __run string")


def test_plain_near_is_distance_one():
    assert near("abcde", "abxde") and near("abcde", "abde") and near("abde", "abcde") and near("abcde", "abcdex") and near("xabcde", "abcde")
    assert not near("abcde", "abcde") and not near("abcde", "badce") and not near("abcde", "bacde") and not near("abcdef", "abcd")


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain(spark, seed):
    rng = np.random.default_rng(seed)
    letters = list("aabcéÿÀ×z")
    stems = ["".join(rng.choice(letters, rng.integers(4, 9))) for _ in range(60)]
    words = []
    for s, times in zip(stems, rng.integers(1, 40, 60)):
        words += [s] * int(times)
        for _ in range(int(times) // 3):
            k, kind = int(rng.integers(0, len(s))), rng.integers(0, 4)
            words += [[s[:k] + s[k + 1 :], s[:k] + "x" + s[k + 1 :], s[:k] + "é" + s[k:], s[:k] + s[k : k + 2][::-1] + s[k + 2 :]][kind]] * int(rng.integers(1, 5))
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::50])) for i in range(50)]
    expected = plain(rows)
    assert sum(f is not None for _, f, *_ in expected) > 10
    assert got(spelling_groups(table(spark, rows))) == expected


def test_chains_of_forms_reach_their_root(spark):
    """Each word of a chain is one letter from the next, which occurs at least twice as often."""
    chain = ["q" * 5 + "w" * k for k in range(8)]
    rows = [(k, " ".join(w for w, n in zip(chain, (3 * 2**j for j in range(8))) for _ in range(n)))] if (k := 3) else []
    expected = plain(rows)
    assert {r[2] for r in expected if r[0].startswith("qqqqq")} >= {chain[-1]}
    assert got(spelling_groups(table(spark, rows))) == expected


def test_odd_rows(spark):
    long = "ab" * 4000
    rows = [(None, None), (1, None), (2, ""), (None, "Straße straße STRASSE strasse"), (3, "Straße straße straßE É éclat Éclat ÉCLAT éclat éclat"), (3, "Straße straße straßE"),
            (4, f"{long} {long} {long}x {long[1:]} {long[1:]} {long[1:]} {long}"), (5, f"{long}x {long}x"), (6, "İstanbul Kelvin kelvin kelvin elvin elvin elvin kelvin 1234 a-b")]
    expected = plain(rows)
    assert (long, long + "x") not in expected and any(len(r[0]) > 7000 and r[4] for r in expected)
    assert got(spelling_groups(table(spark, rows))) == expected
    assert got(spelling_groups(table(spark, rows).limit(0))) == [] and got(spelling_groups(table(spark, rows[:3]))) == []


def test_keys_of_words_and_their_deletions_agree():
    codes = lambda w: np.array([[ord(c) for c in w]], np.uint64)
    rows, keys = deletion_keys(codes("aabca"))
    own = {w: deletion_keys(codes(w))[1][-1] for w in ("aabca", "abca", "aaca", "aaba", "aabc")}
    assert len(keys) == 5 and set(keys.tolist()) == {int(k) for k in own.values()}


def test_long_run_costs_its_length(spark):
    rows, keys = deletion_keys(np.tile(np.array([97, 98], np.uint64), 500_000).reshape(1, -1))
    assert len(keys) == 1_000_001


def test_whole_table_equals_plain(spark, sf, docs):
    assert got(registry.op13_spelling_variants(spark, sf)) == plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
