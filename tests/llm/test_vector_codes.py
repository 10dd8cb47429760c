"""Vector codes against a plain Lloyd on Python integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import registry
from millrace.llm.vector_codes import Books, root, root_up, train, vector_codes


def plain(rows, scale=4096, parts=8, entries=16, rounds=6):
    """rows (vec_id, vector, label) -> (vec_id, code, error, label_error, sha256), sorted."""
    kept = [(i, tuple(math.floor(scale * x) for x in v), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(q, p) for _, q, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min((far(x, c), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, q, _ in kept:
                groups[nearest(cut(q, p), books[p])[1]].append(cut(q, p))
            books[p] = [tuple(sum(c) // len(groups[j]) for c in zip(*groups[j])) if j in groups else e for j, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for i, q, label in kept:
        found = [nearest(cut(q, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    return sorted(((i, c, e, by_label[label], sha) for i, c, e, label in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, q int, upper int, __salt int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_lloyd(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 16))
    values = centres[rng.integers(0, 9, 400)] * 0.2 + rng.normal(size=(400, 16)) * 0.03
    if seed == 2:
        values = np.round(values * 4) / 4  # many ties and equal entries
    rows = [(int(i), v, int(label) if label < 4 else None) for i, v, label in zip(rng.permutation(400), values.astype(np.float32).tolist(), rng.integers(0, 5, 400))]
    assert got(vector_codes(table(spark, rows))) == plain(rows)


def test_odd_rows(spark):
    v = [0.1 * k for k in range(16)]
    rows = [(1, None, 1), (2, [*v[:15], None], 1), (3, [*v[:15], float("nan")], 1), (4, [*v[:15], float("inf")], 1), (5, v, None), (5, v, None), (None, v[::-1], 2), (6, [0.0] * 16, 2), (7, [-0.3] * 16, None)]
    rows = [(i, x and [None if y is None else float(np.float32(y)) for y in x], label) for i, x, label in rows]
    assert got(vector_codes(table(spark, rows))) == plain(rows)
    assert got(vector_codes(table(spark, rows[:4]))) == [] and got(vector_codes(table(spark, rows).limit(0))) == []
    others = [(8, [1.0] * 8, 1), (9, [1.0] * 15, 1), (10, [], 1)]  # of another length than the first, or not cut evenly
    assert got(vector_codes(table(spark, rows + others))) == plain(rows)
    huge = [(1, [1e30] * 16, 1), (2, [-1e30] * 16, 1), (3, [0.5] * 16, 1)]
    assert len(got(vector_codes(table(spark, huge)))) == 3


def test_bounds_spare_scans_and_stay_right(spark):
    """Bounds hold after every round: nearest entries equal a full scan's, and fewer and fewer parts are scanned."""
    rng = np.random.default_rng(5)
    q = np.round((rng.normal(size=(12, 8))[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 8)) * 0.1) * 4096).astype(np.int64)
    books = Books(q[:12].reshape(1, 12, 8).copy())
    code, upper, lower = np.zeros(3000, np.int64), np.full(3000, 1 << 40), np.full(3000, -(1 << 40))
    scans = []
    for _ in range(8):
        scans.append(books.assign(q, 0, code, upper, lower))
        d = ((q[:, None] - books.entries[0]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all()
        own = d[np.arange(3000), code]
        d[np.arange(3000), code] = 1 << 60
        assert (upper**2 >= own).all() and (np.maximum(lower, 0) ** 2 <= d.min(axis=1)).all()
        moved = np.array([[q[code == j].sum(axis=0) // (code == j).sum() if (code == j).any() else books.entries[0, j] for j in range(12)]])
        books = Books(moved, books.entries)
    assert scans[0] > 2900 and scans[-1] < 300
    x = np.array([0, 1, 2, 3, 4, 8, 9, (1 << 29) ** 2 - 1, (1 << 29) ** 2])
    assert root(x).tolist() == [math.isqrt(v) for v in x.tolist()] and root_up(x).tolist() == [math.isqrt(v) + (math.isqrt(v) ** 2 < v) for v in x.tolist()]


def test_whole_table_equals_plain(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    assert got(registry.op12_vector_codes(spark, sf)) == plain([tuple(r) for r in t.collect()])
    rows = t.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 4096).cast("int")).alias("q"))
    scanned = train(rows, 8, 16, 6)[2]
    assert 0.9 * 8 * t.count() < scanned[0] <= 8 * t.count() and scanned[-1] < scanned[0]
