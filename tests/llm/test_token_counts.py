"""Counts equal the libraries'; what the cache knows isn't encoded again."""

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm.registry import tokenizer
from millrace.llm.token_counts import SCHEMA, counter, token_counts, tokenizer_digest

PATH = tokenizer("byte_bpe_50k.json")
LIBRARY, COUNT = Tokenizer.from_file(PATH), counter(PATH)


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    assert COUNT(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["<|endoftext|>x", "<|endoftext|><|endoftext|>", "  a  \n\n b\x1c\x1f\x85  c", "ª º ² ³ ¼ É ÿ ȿ", "we'LL don't", "a" * 3000])
def test_hard_texts(text):
    assert COUNT(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_counts(spark, docs, odd):
    for df in (docs, odd):
        want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids), n > 512) for r in df.collect())
        assert sorted((str(r[0]), *r[1:]) for r in token_counts(df, PATH).collect()) == want
    assert token_counts(odd.limit(0), PATH).count() == 0
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    got = token_counts(docs.where("doc_id < 20"), tokenizer("piece_bpe_32k.model")).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["n_tokens"] == len(model.encode(texts[r["doc_id"]] or "")) for r in got)


def test_cache_is_read_and_appended(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    few = docs.where("doc_id % 2 = 0")
    token_counts(few, PATH, cache).count()
    held = spark.read.parquet(cache)
    n, distinct = held.count(), few.select("text").distinct().count()
    assert n == distinct
    token_counts(docs, PATH, cache).count()
    assert spark.read.parquet(cache).count() == docs.select("text").distinct().count()
    # a planted count is taken as it stands, one of another tokenizer isn't
    from pyspark.sql import functions as F

    planted = docs.where("doc_id = 1").select(F.lit(tokenizer_digest(PATH)).alias("tokenizer"), F.unhex(F.sha2("text", 256)).alias("content"), F.lit(77).cast("long").alias("n_tokens"))
    other = planted.withColumns({"tokenizer": F.lit("x"), "n_tokens": F.lit(5).cast("long")})
    for df, want in ((planted, True), (other, False)):
        at = f"file://{tmp_path}/{want}"
        df.write.parquet(at)
        got = token_counts(docs.where("doc_id = 1"), PATH, at).first()["n_tokens"]
        assert (got == 77) == want and got != 5
    assert SCHEMA.startswith("tokenizer")


@pytest.mark.parametrize("run", [" ", "\n", "\t", "a", "\u3000"])
def test_runs_of_a_million(run):
    t = "x" + run * 1_200_000
    assert COUNT(t) == len(LIBRARY.encode(t, add_special_tokens=False).ids)


def test_few_and_many_misses_give_the_same(docs, odd, monkeypatch):
    from millrace.llm import token_counts as T

    for df in (docs, odd):
        want = sorted(map(str, token_counts(df, PATH).collect()))
        monkeypatch.setattr(T, "FEW", 0)
        assert sorted(map(str, token_counts(df, PATH).collect())) == want
        monkeypatch.undo()
