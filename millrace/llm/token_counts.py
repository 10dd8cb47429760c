"""Token counts through a digest cache.

The cache is a table of (tokenizer, content, n_tokens): the digest of the tokenizer's file, the digest of the normalised
content, and the count. Texts are digested where they are read; the digests are written with the rows' ids. The distinct
digests that the cache lacks are the misses. One text of each is encoded and its count appended; all counts then come from
the cache. Where the misses are few (at most FEW), their digests go to the texts and no other text moves; where they are many,
texts are brought together by digest, one for each task and digest.

Nulls: a null text counts as empty, a null id is kept. Repeated rows share a digest. Extra columns don't matter."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .bpe import byte_characters
from .common import fresh_path, keyed_summary, salt_of, written

SCHEMA = "tokenizer string, content binary, n_tokens long"
#: Misses that are broadcast: 32 bytes each.
FEW = 100_000
#: The split of byte-level files that bring no pattern of their own (fixed: part of the format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str) -> Callable[[str], int]:
    """The number of ids that the library for the file gives for a text, without tokens added at its ends."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        spec = json.loads(f.read())
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    slow = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not spec["normalizer"] and model["type"] == "BPE"
    if not plain or any(model.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "ignore_merges")):
        return slow
    byte = {c: b for b, c in enumerate(byte_characters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
    merged = [ranks[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
    if merged != sorted(merged):  # ids must rise with the merges' ranks
        return slow
    quick = tiktoken.Encoding("counts", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
    late = "ɐ"  # beyond, the two libraries may class letters by different Unicode versions

    def count(t: str) -> int:
        if not t.isascii() and max(t) >= late:
            return slow(t)
        try:
            return len(quick.encode(t, allowed_special="all"))
        except ValueError:  # its pattern gives up on very long runs of white space
            return slow(t)

    return count


_counters: dict[str, Callable[[str], int]] = {}


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """texts(content, text) -> (content, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = counter(path)
        count = _counters[path]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t.as_py()) for t in b.column(1)], pa.int64())], ["content", "n_tokens"])

    return texts.mapInArrow(run, "content binary, n_tokens long")


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none where it isn't there yet. A count that two runs appended at the same time is there twice."""
    try:
        return spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of each row. cache: a folder that driver and executors share; without one this
    call has a cache of its own. normalise: what the tokenizer's own normaliser makes equal may be made equal here."""
    spark = docs.sparkSession
    cache, version = cache or fresh_path(spark, "token-counts"), tokenizer_digest(path)
    text = F.coalesce(normalise(F.col(text_col)), F.lit(""))
    content = F.unhex(F.sha2("__text", 256)).alias("content")
    texts = docs.select(F.col(id_col).alias("__id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), text.alias("__text"))
    rows = written(texts.select("__id", "n_bytes", content).withColumn("__salt", salt_of(F.monotonically_increasing_id())), "token-digests")
    known = cached(spark, cache).where(F.col("tokenizer") == version).select("content")
    misses = written(rows.select("content").distinct().join(known, "content", "left_anti"), "token-misses")
    n = misses.count()
    if n:
        wanted = texts.select(content, "__text")
        if n <= FEW:
            wanted = wanted.join(F.broadcast(misses), "content", "left_semi").groupBy("content").agg(F.first("__text").alias("__text"))
        else:
            wanted = wanted.groupBy("content").agg(F.first("__text").alias("__text")).join(misses, "content", "left_semi")
        encode_counts(wanted, path).select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    counts = cached(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    places = keyed_summary(rows, ["content"], "__salt", {"n": F.count(F.lit(1))}, {"n": F.sum("n")})
    counted = places.join(counts, "content").select("content", "__salt", "n_tokens")
    return rows.join(counted, ["content", "__salt"]).select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
