"""Spelling variants by a symmetric-delete join.

Words are counted over all texts. Every word gives itself and its distinct single deletions as keys; words that share a key
are candidates, and those at distance exactly one are near. Keys are digests, made for all positions of a word at once from
running sums, so that a word of a million letters costs as much as a million letters; equal digests only propose, the distance
decides. A key of m letters belongs to itself and to what one inserted letter makes of it, so that no key has more than
(m + 1) x alphabet words, however often these occur. A word's form is its near word with the largest count, where that is
at least `times` its own. Counts rise along forms, so that there is no circle, and roots are found by doubling pointers, in a
number of rounds that grows with the logarithm of the longest path.

A null text has no words; a null id counts as an empty one where the digest of id and run decides on a deletion. Empty texts and
tables give no words. Repeated rows each count. Ties go to the form that is first in code-point order. Extra columns don't matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RUN = "[A-Za-zÀ-ÿ]+"
#: One in so many runs, by the digest of id and run, loses a letter.
LOSSES = 97
#: Letters of a batch whose keys are made at once.
CELLS = 1 << 20


def lowered(run: Column) -> Column:
    """A run with only A-Z in lower case. lower() changes the capitals from U+00C0 to U+00DE too, so runs that have some are mapped letter by letter."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(run.rlike("[À-Þ]"), F.translate(run, letters, letters.lower())).otherwise(F.lower(run))


def occurring(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(word) for each run of at least `least` letters; some lose one."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("__run"))
    low = runs.where(F.char_length("__run") >= least).select("__id", lowered(F.col("__run")).alias("__run"))
    drawn = low.select("__run", F.crc32(F.concat_ws(":", "__id", "__run").cast("binary")).alias("__h"))
    at = F.pmod(F.col("__h"), F.char_length("__run").cast("long")).cast("int")
    cut = F.concat(F.substring("__run", F.lit(1), at), F.substring(F.col("__run"), at + 2, F.char_length("__run")))
    return drawn.select(F.when(F.col("__h") % LOSSES == 0, cut).otherwise(F.col("__run")).alias("word")).where(F.char_length("word") >= least)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    return occurring(docs, id_col, text_col, least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


#: Two primes below 2^31 and a base for each: fixed values of the keys' digests.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 69_069)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def deletion_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes (words, letters) of words of one length -> (row, key): each word's own digest and those of its distinct deletions.

    A digest is the sum of (letter + 1) * base^place; without the letter at j it is the sum before j and that after j, one place down."""
    n, length = codes.shape
    keep = np.ones((n, length + 1), bool)
    keep[:, 1:length] = codes[:, 1:] != codes[:, :-1]  # a letter equal to the one before leaves the same word
    keys = np.zeros((n, length + 1), np.uint64)
    for prime, base in zip(PRIMES, BASES):
        p = np.uint64(prime)
        terms = (codes + np.uint64(1)) * _powers(base, prime, length) % p
        sums = np.cumsum(terms, axis=1, dtype=np.uint64) % p
        after = (sums[:, -1:] + p - sums) * np.uint64(pow(base, -1, prime)) % p
        before = np.concatenate([np.zeros((n, 1), np.uint64), sums[:, :-1]], axis=1)
        digests = np.concatenate([(before + after) % p, sums[:, -1:]], axis=1)
        keys = (keys << np.uint64(31)) | digests
    rows, _ = np.nonzero(keep)
    return rows, keys[keep].view(np.int64)


def keyed(words: DataFrame) -> DataFrame:
    """words(id, word) -> (key, id)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            lengths = np.array([len(t) for t in texts], np.int64)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                for part in np.array_split(at, min(len(at), len(at) * length // CELLS + 1)):
                    codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(part), length)
                    rows, keys = deletion_keys(codes)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[part][rows])], ["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def near_words(words: DataFrame) -> DataFrame:
    """words(id, word, n) -> (a, b): ids of words at distance exactly one, both ways."""
    keys = written(keyed(words), "deletion-keys")
    left, right = keys.select("key", F.col("id").alias("a")), keys.select("key", F.col("id").alias("b"))
    pairs = left.join(right, "key").where("a < b").select("a", "b").distinct()
    text = lambda side: words.select(F.col("id").alias(side), F.col("word").alias(f"{side}_word"))
    near = pairs.join(text("a"), "a").join(text("b"), "b").where(F.levenshtein("a_word", "b_word", 1) == 1)
    return near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")


def last_forms(links: DataFrame) -> DataFrame:
    """links(id, form_id) without circles -> (id, root_id): where each id's path of forms ends."""
    at = written(links.select("id", F.col("form_id").alias("root_id"), F.lit(True).alias("moved")), "roots")
    while not at.where("moved").isEmpty():
        on = at.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        at = written(at.join(on, "root_id", "left").select("id", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")), "roots")
    return at.select("id", "root_id")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """One row per word: (word, form, root, n, n_near, form_n)."""
    counted = written(vocabulary(docs, id_col, text_col, least_letters, least_count), "vocabulary")
    words = written(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    other = words.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word", F.col("id").alias("form_id")).alias("other"))
    best = near_words(words).join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    is_form = -F.col("best.less") >= times * F.col("n")
    found = words.join(best, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(is_form, c).alias(a) for a, c in (("form", F.col("best.word")), ("form_n", -F.col("best.less")), ("form_id", F.col("best.form_id")))))
    forms = written(found, "forms")
    roots = last_forms(forms.where("form_id IS NOT NULL").select("id", "form_id"))
    named = roots.join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    return forms.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
