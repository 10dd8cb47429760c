"""BPE encoding and decoding of tokenizer files (JSON, byte-level BPE with or without word ends).

Encoding finds all tokens inside a word with an Aho-Corasick automaton and walks the word with the longest match at each
place. A token may follow another only if merging their joined text gives just these two (the pair-compatibility table,
filled as pairs occur); where that fails the next shorter token is tried, and a place that no token can leave is marked and
never entered again, so each place is left once per token that starts there: time is linear in the word's length. A
sequence whose neighbours are all compatible is the one that the merges give.

Decoding gathers token bytes from one blob through an offset table.

Words recur, so each worker keeps a bounded memo of what it encoded last."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex as LibraryRegex
from tokenizers import Tokenizer, normalizers, pre_tokenizers

#: Entries of a memo's generation; a worker holds two generations of each memo.
MEMO = 350_000
#: Longer words are encoded each time.
LONGEST = 256
#: Stands for the word-end suffix inside words; byte-level characters never include it.
END = "\0"
#: Control characters that str.split() takes for white space and the tokenizers' patterns don't.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"\p{White_Space}+")
#: The split of byte-level files that bring no pattern of their own.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


_NFC = normalizers.NFC()
#: Below this character regex and the tokenizers library agree about letters, numbers and case.
_KNOWN = "\u0250"


def _ranges(chars: Iterable[str]) -> str:
    """Characters as the inside of a set."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _as_library(kind: str) -> str:
    """The set of characters that the library takes for category kind: its Unicode version differs from that of regex."""
    both = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    theirs = pre_tokenizers.Split(LibraryRegex(rf"[\p{{{kind}}}]+"), "removed", invert=True)
    ours = regex.sub(rf"\P{{{kind}}}+", "", both)
    less = {*ours} - {*"".join(t for t, _ in theirs.pre_tokenize_str(ours))}
    return rf"[\p{{{kind}}}--[{_ranges(less)}]]" if less else rf"\p{{{kind}}}"


def _later_cases() -> dict[int, str]:
    """Letters that the library lower-cases and this Python, of an older Unicode version, doesn't."""
    new = "".join(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn")
    return {ord(a): b for a, b in zip(new, normalizers.Lowercase().normalize_str(new), strict=True) if a != b}


class Memo(dict):
    """What make() gave for the last keys, in two generations; bounded."""

    def __init__(self, make, most: int = MEMO) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    fresh = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(fresh)) for b in range(256)]


class Merges:
    """The vocabulary and merges of a BPE model, over words as strings of byte characters."""

    def __init__(self, model: dict) -> None:
        self.suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models can be encoded")
        own = lambda t: t[: -len(self.suffix)] + END if self.suffix and t.endswith(self.suffix) else t
        self.ids = {own(t): i for t, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(own(a), own(b)): n for n, (a, b) in enumerate(pairs)}
        self.texts = {i: t for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        reached = {t: i for t, i in self.ids.items() if self.by_merging(t) == [t]}
        for t, i in reached.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.length = {i: len(t) for t, i in reached.items()}
        self.shorter = {i: next((reached[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in reached), -1) for t, i in reached.items()}
        self.fits = Memo(self._fits, 4 * MEMO)

    def units(self, word: str) -> list[str]:
        return [*word[:-2], word[-2:]] if word.endswith(END) and len(word) > 1 else list(word)

    def by_merging(self, word: str) -> list[str]:
        """The merges applied one after another, the lowest rank first; of equals the leftmost."""
        parts, ranks = self.units(word), self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, pair: tuple[int, int]) -> bool:
        a, b = self.texts[pair[0]], self.texts[pair[1]]
        return self.by_merging(a + b) == [a, b]

    def encode(self, word: str) -> list[int]:
        """Ids of a word of byte characters, with END if the model has word ends."""
        n, length, shorter, fits = len(word), self.length, self.shorter, self.fits
        longest = [-1] * (n + 1)
        for end, (size, i) in self.automaton.iter(word):  # matches come by their ends, so the last of a start is the longest
            longest[end - size + 1] = i
        open_ = bytearray(b"\1") * (n + 1)
        if self.suffix:
            open_[n - 1] = 0  # END isn't a token of its own
        out, at, token = [], 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if open_[end] and (not out or fits[out[-1], token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, token = end, longest[end]
            elif out:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
            else:
                raise ValueError(f"no tokens for {word!r}")
        return out


class Codec:
    """Encodes and decodes as the file at path says."""

    def __init__(self, path: str, library: bool = False) -> None:
        """library: merge words by the tokenizers library instead of the backtracking encoder; the ids are the same."""
        with open(path, "rb") as f:
            self.file = f.read()
        self.model = Tokenizer.from_str(self.file.decode()).model if library else None
        spec = json.loads(self.file)
        self.merges = None if library else Merges(spec["model"])
        self.end = END if spec["model"].get("end_of_word_suffix") else ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match as they stand")
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]] if spec["normalizer"] else [])]
        pre = spec["pre_tokenizer"]
        self.by_space = steps == ["NFC", "Replace", "Lowercase"] and pre["type"] == "Sequence"
        if self.by_space:
            pattern = pre["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        elif not steps and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]:
            pattern = _BYTE_LEVEL
        else:
            raise ValueError("the file's normalizer or split isn't known")
        self.fast = regex.compile(pattern)
        for kind in "LN":
            pattern = pattern.replace(rf"\p{{{kind}}}", _as_library(kind))
        self.exact = regex.compile(pattern, regex.V1)
        self.cases = _later_cases() if self.by_space else {}
        self.shown = byte_characters()
        self.words = Memo(self._word, MEMO // 2)
        self.chunks = Memo(self._chunk)
        raw = {c: bytes([b]) for b, c in enumerate(self.shown)}
        by_bytes = (spec["decoder"] or {}).get("type") == "ByteLevel"
        self.separator = b"" if by_bytes else b" "
        shown = dict(sorted([*((i, t) for t, i in spec["model"]["vocab"].items()), *((i, t) for t, i in self.special.items())]))
        self.table = OffsetTable((b"".join(raw.get(c, c.encode()) for c in shown.get(i, "")) if by_bytes and i not in self.special.values() else shown.get(i, "").encode()) + self.separator for i in range(max(shown) + 1))
        self.decimals = OffsetTable(b"%d " % i for i in range(max(shown) + 1))

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() and " " not in word else "".join([self.shown[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(shown)] if self.model else self.merges.encode(shown + self.end)
        return array("I", ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Of normalized text without white space."""
        if chunk.isascii() and chunk.isalpha():
            return self.words[chunk]
        return b"".join([self.words[w] for w in self.split(chunk)])

    def normalized(self, text: str) -> str:
        """NFC and lower case, letter by letter as the library; white space is left to the split."""
        if not text.isascii():
            if max(text) < _KNOWN:
                text = unicodedata.normalize("NFC", text)
            else:  # the library orders and joins marks by its own Unicode version
                text = _NFC.normalize_str(text).replace("Σ", "σ").translate(self.cases)
        return text.lower()

    def split(self, text: str) -> list[str]:
        return (self.fast if text.isascii() or max(text) < _KNOWN else self.exact).findall(text)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_pattern and "<" in text and self.special_pattern.search(text):
            out, at = [], 0
            for m in self.special_pattern.finditer(text):
                out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not self.by_space:
            return b"".join([self.words[w] for w in self.split(text)])
        text = self.normalized(text)
        return b"".join(map(self.chunks.__getitem__, _SPACES.split(text) if _ODD_SPACE.search(text) else text.split()))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        """The decoded text's bytes, in pieces."""
        return trimmed(self.table.gather(ids), len(self.separator))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.decoded(ids)).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> Iterator[bytes]:
        """Decimal ids joined by one space, in pieces."""
        return trimmed(self.decimals.gather(ids), 1)


def trimmed(parts: Iterable[bytes], last: int) -> Iterator[bytes]:
    """Without so many bytes of the last part."""
    held = b""
    for x in parts:
        yield held
        held = x
    yield held[: len(held) - last] if last else held


class OffsetTable:
    """Byte strings in one blob, by number."""

    def __init__(self, entries: Iterable[bytes]) -> None:
        entries = list(entries)
        self.sizes = np.array([len(x) for x in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(entries), np.uint8)

    def gather(self, numbers: np.ndarray, most: int = 65_536) -> Iterator[bytes]:
        """The entries joined, so many at a time."""
        for k in range(0, len(numbers), most):
            part = numbers[k : k + most]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            yield self.blob[np.arange(ends[-1]) + np.repeat(self.starts[part] - ends + sizes, sizes)].tobytes()


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, library: bool = False) -> Codec:
    """One for each file and worker."""
    if (path, library) not in _codecs:
        _codecs[path, library] = Codec(path, library)
    return _codecs[path, library]


def digest(parts: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for x in parts:
        h.update(x)
    return h.hexdigest()


def encoded(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids array<int>, decoded string) of each row. A null text counts as empty; an empty text has no ids.

    Rows are independent: repeated rows repeat, extra columns don't matter. path must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encoded_digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of each row: what encoded() gives, as digests of the decimal ids joined
    by one space and of the decoded text. Nulls and repeated rows as there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            out = []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                text = digest(c.decoded(ids)) if c.separator else digest([c.decode(ids).encode()])
                out.append((len(ids), digest(c.decimal(ids)), text))
            n, a, d = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
