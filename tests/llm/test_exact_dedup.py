"""Groups equal those by whole texts, also where digests clash."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm.exact_dedup import MOST, chunks, exact_groups, keep_exact


def key(x):
    return -(10**9) if x is None else x


def brute(rows):
    """rows [(id, text)] -> sorted (id, keep_id, size, digest), and how many rows each group keeps."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((key(i), key(max(g, key=key)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), len(groups)


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(7).cast("long")], ids=["xxhash", "length", "constant"])
def test_groups(docs, texts, odd, digest):
    for df, rows in ((docs, list(texts.items())), (odd, [(r["doc_id"], r["text"]) for r in odd.collect()])):
        got = exact_groups(df, digest=digest).collect()
        want, n = brute(rows)
        assert sorted((key(r["doc_id"]), key(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == n and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_chunks_join_to_the_text(spark):
    texts = ["", "a", "x" * (3 * MOST + 5), "One. Two! " * 900, "line\n" * 2000, "\U0001f600" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunks(F.col("t")).alias("c"))
    for r in df.collect():
        assert "".join(r["c"]) == texts[r["i"]] and all(0 < len(c) <= MOST for c in r["c"])


def test_chunks_of_equal_passages_are_equal(spark):
    """A change near the front leaves later chunks as they are."""
    tail = "".join(f"Sentence {i} stands here. " for i in range(2000))
    a, b = (set(r[0]) for r in spark.createDataFrame([("First. " + tail,), ("Another beginning of this text. " + tail,)], "t string").select(chunks(F.col("t"))).collect())
    assert len(a & b) > 0.8 * len(a)


def test_keep(odd):
    kept = keep_exact(odd)
    assert kept.columns == odd.columns
    assert sorted(key(r["doc_id"]) for r in kept.collect()) == sorted(key(i) for i in [None, 2, 3, 4, 6, 7, 8])
    assert keep_exact(odd.limit(0)).count() == 0 == exact_groups(odd.limit(0)).count()


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "".join(map(chr, range(0xAC00, 0xAC00 + 300)))], ids=["latin", "cyrillic", "greek", "arabic", "han", "hangul"])
def test_cuts_follow_the_content_in_every_script(spark, letters):
    """One more letter in front leaves most chunks of a long text as they are."""
    import random

    rng = random.Random(3)
    weights = [1 / (1 + k) for k in range(len(letters))]
    text = " ".join("".join(rng.choices(letters, weights, k=rng.randint(2, 9))) for _ in range(20_000))
    a, b = (set(r[0]) for r in spark.createDataFrame([(text,), (letters[3] + text,)], "t string").select(chunks(F.col("t"))).collect())
    assert len(a & b) > 0.5 * len(a)
