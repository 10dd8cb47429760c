"""Ids and decoded text equal the tokenizers library's."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm.bpe import Codec, Merges, OffsetTable, codec, encoded, encoded_digests
from millrace.llm.registry import tokenizer

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
HARD = ["", " ", "a" * 5000, "ab" * 3000, "\n\n\t x", "İstanbul ΑΣ Σ ς", "é é", "<|endoftext|>a<|startoftext|>", "<|endoftext", "don't WE'LL", "١٢٣ ½ ²", "\x1c\x1d a b c　", "\U0001f600‍\U0001f468", "한국어 ไทย हिन्दी", "ǅ ﬁ ß ẞ", "\u0085x᠎", "a\0b"]


@pytest.fixture(scope="module")
def library():
    return {f: Tokenizer.from_file(tokenizer(f)) for f in FILES}


def same(library, file, text):
    want = library[file].encode(text, add_special_tokens=False).ids
    got = codec(tokenizer(file)).encode(text).tolist()
    assert got == want
    assert codec(tokenizer(file)).decode(codec(tokenizer(file)).encode(text)) == library[file].decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("file", FILES)
def test_documents_and_hard_texts(library, file, texts):
    for t in [*HARD, *texts.values()]:
        same(library, file, t or "")


@given(st.text(max_size=80), st.sampled_from(FILES))
@settings(max_examples=400, deadline=None)
def test_any_text(text, file):
    global _library
    _library = globals().get("_library") or {f: Tokenizer.from_file(tokenizer(f)) for f in FILES}
    same(_library, file, text)


def test_backtracking_equals_merging():
    """A small vocabulary in which the longest match often leads astray."""
    vocab = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa", "bca"]
    merges = [["b", "c"], ["a", "b"], ["c", "a"], ["a", "a"], ["a", "bc"], ["c", "ab"], ["bc", "a"]]
    m = Merges({"type": "BPE", "vocab": {t: i for i, t in enumerate(vocab)}, "merges": merges})
    import itertools

    for n in range(1, 9):
        for w in map("".join, itertools.product("abc", repeat=n)):
            assert [vocab[i] for i in m.encode(w)] == m.by_merging(w)


def test_library_merging_gives_the_same(texts):
    quick, own = Codec(tokenizer(FILES[0]), library=True), codec(tokenizer(FILES[0]))
    assert all(quick.encode_bytes(t or "") == own.encode_bytes(t or "") for t in [*HARD, *texts.values()])


def test_offset_table():
    import numpy as np

    t = OffsetTable([b"a", b"", b"bcd"])
    assert b"".join(t.gather(np.array([2, 1, 0, 2]), 2)) == b"bcdabcd" and list(t.gather(np.array([], int))) == []


def test_queries(spark, odd, library):
    t, path = library[FILES[0]], tokenizer(FILES[0])
    want = sorted((str(r["doc_id"]), len(ids := t.encode(r["text"] or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for r in odd.collect())
    assert sorted((str(r[0]), *r[1:]) for r in encoded_digests(odd, path).collect()) == want
    assert [len(r["ids"]) for r in encoded(odd.where("doc_id = 2"), path).collect()] == [0]
    assert encoded_digests(odd.limit(0), path).count() == 0


#: Marks that this Python's tables class otherwise than the library's.
LATER = [chr(c) for c in (0x7FD, 0x898, 0x8D3, 0x9FE, 0xC3C, 0xD3B, 0xEBA, 0x1715, 0x1734, 0x1ABF, 0x1DF6, 0xA8C5, 0x10D24, 0x11A34)]


@pytest.mark.parametrize("file", FILES)
def test_marks_of_later_versions(library, file):
    quick = Codec(tokenizer(FILES[0]), library=True)
    for m in LATER:
        for t in ("x́" + m, f"a{m}̣́b", m + "̀", f"é{m} Ab{m}"):
            same(library, file, t)
            assert quick.encode(t).tolist() == library[FILES[0]].encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n", "a", "-", "　", "é"])
def test_long_runs(library, run):
    t = run * 200_000
    for file in FILES:
        assert codec(tokenizer(file)).encode("x" + t).tolist() == library[file].encode("x" + t, add_special_tokens=False).ids
    assert not any(len(k) > 1000 for k in codec(tokenizer(FILES[0])).words)
