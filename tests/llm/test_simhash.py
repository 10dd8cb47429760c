"""Fingerprints by the definition, components by comparing all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash as S


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(items):
    """items {id: fingerprint} -> {id: smallest id reachable}"""
    ids = sorted(items)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (items[i] ^ items[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint(texts):
    for t in [*texts.values(), "", None, "a", "A b", "a b c d", "É Ä b\x1cc x", "a  b\n\nc\td e"]:
        assert S.fingerprint(t or "") == plain(t)


def test_groups(spark, docs, texts):
    want = {i: plain(t) for i, t in texts.items()}
    got = {r["doc_id"]: r for r in S.near_groups(docs).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in want.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute(want)
    assert {i for i, r in got.items() if r["kept"]} == set(brute(want).values())


@pytest.mark.parametrize("seed", range(3))
def test_components_of_planted_fingerprints(spark, seed):
    """Chains, stars and dense balls: many fingerprints in one cell, links that only few cells show."""
    rng = random.Random(seed)
    found = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice((1, 3, 40))):  # a ball, or a chain that wanders off
            at = centre if seed != 1 else (rng.choice(sorted(found)) if found else centre)
            for _ in range(rng.randint(0, 6)):
                at ^= 1 << rng.randrange(64)
            found.add(at)
    items = dict(enumerate(sorted(found)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x), 1 + i % 3) for i, x in items.items()], "fp long, n long")
    roots = {r["fp"] & (1 << 64) - 1: r["root"] for r in S.fingerprint_components(df).collect()}
    number, groups = brute(items), {}
    for i, x in items.items():
        groups.setdefault(number[i], set()).add(x)
    linked = {frozenset(g) for g in groups.values() if len(g) > 1}
    got = {}
    for x, r in roots.items():
        got.setdefault(r, set()).add(x)
    assert {frozenset(g) for g in got.values()} == linked


def test_lower_bound(spark):
    rng = random.Random(0)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    count = lambda x: [(x >> 2 * k & 3).bit_count() for k in range(32)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", S.manhattan(S.embedding(F.col("a")), S.embedding(F.col("b"))).alias("m")).collect()
    for r in rows:
        assert r["m"] == sum(abs(x - y) for x, y in zip(count(r["a"]), count(r["b"]))) <= (r["a"] ^ r["b"]).bit_count()


def test_odd_rows(odd):
    rows = odd.collect()
    got = S.near_groups(odd).collect()
    assert len(got) == len(rows) and {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 4)} == {"0" * 16}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 4)} == {None}  # with the row without id and text
    kept = S.keep_near(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got) == len({r["fingerprint"] for r in got})
    assert S.keep_near(odd.limit(0)).count() == 0 == S.near_groups(odd.limit(0)).count()
