"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import registry
from millrace.llm.embedding_dedup import forest, most_different, near_vectors, passes


def plain(rows, least=0.98):
    """rows (vec_id, vector, label) -> (vec_id, n_links, component_id, kept), sorted."""
    ok = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(ok):
        for b in ok[:i]:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if rows[a][2] == rows[b][2] and len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= least:
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    smallest = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            smallest[find(k)] = min(smallest.get(find(k), r[0]), r[0])
    out = [(r[0], n[k], smallest.get(find(k))) for k, r in enumerate(rows)]
    return sorted(((i, m, c, i == c) for i, m, c in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], f"vec_id long, embedding array<{kind}>, label int, root int, n int, lab string, win int")


def clustered(rng, n, width=32):
    """Single vectors, pairs about the threshold, groups of near copies, a chain, and copies."""
    out, unit = [], lambda: rng.normal(size=width) / np.sqrt(width)
    for k in range(n):
        c = unit()
        for noise in [0] + [0.2 * rng.random()] * (k % 4 == 0) + list(0.14 * rng.random(40)) * (k % 50 == 0):
            out.append(c + noise * unit())
    a, b = unit(), unit()
    out += [a * np.cos(t) + b * np.sin(t) for t in np.arange(0, 2, 0.15)]
    return np.array(out + out[:7] + out[:7])


@pytest.mark.parametrize("seed,block", [(0, 4096), (1, 12)])
def test_equals_all_pairs(spark, seed, block):
    rng = np.random.default_rng(seed)
    v = clustered(rng, 260)
    rows = [(int(i), x, int(lab)) for i, x, lab in zip(rng.permutation(len(v)) * 3, v.tolist(), np.where(rng.random(len(v)) < 0.1, 1, 0))]
    expected = plain(rows)
    assert max(r[1] for r in expected) > 20 and sum(r[1] > 0 for r in expected) > 100
    assert got(near_vectors(table(spark, rows), block=block)) == expected


def test_tight_group_is_counted_by_its_core(spark):
    """A component of many blocks whose vectors nearly all stand close to the mean."""
    rng = np.random.default_rng(3)
    c = rng.normal(size=24)
    v = np.concatenate([c + 0.02 * rng.normal(size=(300, 24)), c + 0.25 * rng.normal(size=(30, 24)), rng.normal(size=(40, 24))])
    rows = [(k, x, 5) for k, x in enumerate(v.tolist())]
    assert got(near_vectors(table(spark, rows), block=20)) == plain(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, None, 1), (2, [*v[:3], None], 1), (3, [*v[:3], float("nan")], 1), (4, [*v[:3], float("inf")], 1), (5, [0.0] * 4, 1), (6, [0.0] * 4, 1), (7, v, None), (8, v, None),
            (9, v, 1), (9, v, 1), (10, [2 * x for x in v], 1), (None, v, 1), (None, v, 2), (11, v, 3), (12, v[:3], 1), (13, v[:3], 1), (14, [], 1), (15, [-x for x in v], 1),
            (16, [1e-300 * x for x in v], 1), (17, [1e300 * x for x in v], 1), (18, [0.0, 1.0, 0.0, 0.0], 4), (19, [-0.0, 1.0, 0.0, -0.0], 4)]
    rows = rows[:-6] + rows[-6:]
    expected = plain([r for r in rows if r[0] not in (16, 17)] + [(i, v, 1) for i in (16, 17)])
    found = got(near_vectors(table(spark, rows)))
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert all(r[3] == (r[0] == r[2]) for r in found)
    assert got(near_vectors(table(spark, rows).limit(0))) == [] and len(got(near_vectors(table(spark, rows[:8], "float")))) == 8


def test_helpers():
    linked = np.eye(6, dtype=bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert forest(linked).tolist() == [0, 1, 1, 0, 4, 0]
    assert passes(0, 0.98) >= 1 and passes(10**9, 0.98) > passes(10**4, 0.98) and 16 < most_different(0.98) < 60


def test_planted_among_given_vectors(spark, sf):
    """Near copies of every fifth given vector, at cosines from 0.97 to 1."""
    t = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    rng, rows = np.random.default_rng(8), [(r["vec_id"], list(map(float, r["embedding"])), r["label"]) for r in t]
    for k, (_, v, lab) in enumerate(rows[:500:5]):
        for noise in (0.02, 0.1, 0.19, 0.25)[: k % 5]:
            rows.append((10_000 + len(rows), (np.array(v) + noise * rng.normal(size=len(v)) / 8).tolist(), lab))
    assert got(near_vectors(table(spark, rows))) == plain(rows)
    assert got(registry.op11_embedding_near_dedup(spark, sf)) == plain([(r["vec_id"], r["embedding"], r["label"]) for r in t])
