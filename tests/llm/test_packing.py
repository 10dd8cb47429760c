"""Best fit against a plain search, and every id in exactly one piece."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm.packing import best_fit_decreasing, packed
from millrace.llm.registry import tokenizer

PATH = tokenizer("word_bpe_49k.json")


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=200, deadline=None)
def test_best_fit_equals_plain_search(lengths):
    lengths, left, want = sorted(lengths, reverse=True), [], []
    for size in lengths:
        room = min((c for c in left if c >= size), default=None)
        want.append(64 - room if room is not None else 0)
        if room is not None:
            left.remove(room)
        left.append((room if room is not None else 64) - size)
    place, offset = best_fit_decreasing(lengths, 64)
    assert offset == want and len(set(place)) == len(left)
    assert sorted(64 - sum(s for s, q in zip(lengths, place) if q == p) for p in set(place)) == sorted(left)


def check(rows, texts, window=2048):
    """rows over texts [(id, text)]: spans cover each document, digests are right, sequences are gapless."""
    library = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] += [(s, min(window, len(ids) - s), zlib.crc32(ids[s : s + window].tobytes()), len(ids)) for s in range(0, len(ids), window)]
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sequences


@pytest.mark.parametrize("shard", [50_000, 20])
def test_pieces_cover_documents(spark, docs, texts, shard):
    sequences = check(packed(docs, PATH, shard=shard).collect(), texts.items())
    if shard == 50_000:
        used = sum(n for p in sequences.values() for _, n in p)
        assert used / (2048 * len(sequences)) > 0.97


def test_odd_rows(odd):
    check(packed(odd, PATH).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packed(odd.limit(0), PATH).collect() == []
