"""Language identification by a byte convolutional network.

A text's lower-cased UTF-8 bytes are cut into windows of WINDOW bytes, the last one padded with zero. Each window goes through a
byte embedding, filters of several widths, a rectifier, the maximum over places, and a softmax over languages. A text's
probabilities are the mean of its windows', weighted by their bytes; all windows of the whole text count. The network is
trained in numpy on a bounded sample of labelled rows; every language with a label is learned, and each epoch draws anew from
all windows of a row's whole text. For use, embedding and filters are multiplied out into one table for
each width and place, so that a window costs look-ups and sums.

Nulls: a null text or one without a letter is `und` with score 0; rows whose label is null or whose id is null aren't learned
from. Ties go to the language first in order. Repeated rows each get the same answer. Without any labelled row every text is
`und`. Extra columns don't matter."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 12
#: Bounds of the sample of labelled rows: of a language, and in all (but one row of each language at least).
PER_LANGUAGE, IN_ALL = 1500, 20_000
#: Windows that an epoch learns from for each row of the sample, drawn from all windows of its whole text.
PER_EPOCH = 4
EPOCHS, BATCH, RATE, SEED = 12, 128, 0.004, 1
UNKNOWN = "und"


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, bytes of each that are the text's)."""
    raw = text.lower().encode("utf-8", "replace")
    n = -(-len(raw) // WINDOW)
    cut = np.zeros(n * WINDOW, np.uint8)
    cut[: len(raw)] = np.frombuffer(raw, np.uint8)
    sizes = np.full(n, WINDOW, np.float32)
    if n:
        sizes[-1] = len(raw) - (n - 1) * WINDOW
    return cut.reshape(n, WINDOW), sizes


class Network:
    """The weights; predicts from tables made of them."""

    def __init__(self, languages: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.languages = languages
        self.weights = {"embedding": draw(256, EMBEDDING, scale=0.3), "out": draw(len(WIDTHS) * FILTERS, len(languages), scale=0.1), "out_bias": np.zeros(len(languages), np.float32)}
        for w in WIDTHS:
            self.weights |= {f"filters{w}": draw(w, EMBEDDING, FILTERS, scale=(2 / (w * EMBEDDING)) ** 0.5), f"bias{w}": np.zeros(FILTERS, np.float32)}
        self.refresh()

    def refresh(self) -> None:
        """The tables: what each byte at each place of a filter adds."""
        self.tables = {w: np.einsum("be,jef->jbf", self.weights["embedding"], self.weights[f"filters{w}"]).astype(np.float32) for w in WIDTHS}

    def pooled(self, cut: np.ndarray, places: bool = False):
        """The rectified maxima of each filter; with places, also where they are."""
        found, at = [], []
        for w in WIDTHS:
            last = cut.shape[1] - w + 1
            total = self.tables[w][0][cut[:, :last]]
            for j in range(1, w):
                total += self.tables[w][j][cut[:, j : j + last]]
            if places:
                at.append(total.argmax(axis=1))
            found.append(total.max(axis=1) + self.weights[f"bias{w}"])
        out = np.maximum(np.concatenate(found, axis=1), 0)
        return (out, at) if places else out

    def probabilities(self, cut: np.ndarray, most: int = 256) -> np.ndarray:
        parts = []
        for k in range(0, len(cut), most):
            logits = self.pooled(cut[k : k + most]) @ self.weights["out"] + self.weights["out_bias"]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            parts.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, cut: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        pooled, at = self.pooled(cut, places=True)
        logits = pooled @ self.weights["out"] + self.weights["out_bias"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(len(cut)), labels] -= 1
        d /= len(cut)
        grads = {"out": pooled.T @ d, "out_bias": d.sum(axis=0), "embedding": np.zeros_like(self.weights["embedding"])}
        back = (d @ self.weights["out"].T) * (pooled > 0)
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grads[f"bias{w}"] = g.sum(axis=0)
            filters = np.zeros_like(self.weights[f"filters{w}"])
            for j in range(w):
                bytes_ = np.take_along_axis(cut, at[k] + j, axis=1)
                filters[j] = np.einsum("bfe,bf->ef", self.weights["embedding"][bytes_], g)
                np.add.at(grads["embedding"], bytes_, g[:, :, None] * self.weights[f"filters{w}"][j].T[None])
            grads[f"filters{w}"] = filters
        return grads

    def train(self, cut: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """cut: rows x draws x WINDOW bytes; an epoch uses its own share of the draws. Adam, with a rate that falls to zero;
        classes weigh the same by drawing each equally often."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        of_class = [np.flatnonzero(labels == c) for c in range(len(self.languages))]
        draws = cut.shape[1]
        each = max(map(len, of_class)) * min(draws, PER_EPOCH)
        steps, step = epochs * -(-each * len(of_class) // BATCH), 0
        for epoch in range(epochs):
            rows = rng.permutation(np.concatenate([np.resize(rng.permutation(x), each) for x in of_class]))
            draw = (epoch * PER_EPOCH + rng.integers(PER_EPOCH, size=len(rows))) % draws
            for k in range(0, len(rows), BATCH):
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for name, g in self.gradients(cut[rows[k : k + BATCH], draw[k : k + BATCH]], labels[rows[k : k + BATCH]]).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    self.weights[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                self.refresh()


def held_out(id_col: str) -> Column:
    """Rows that aren't learned from: crc32 of the id's decimal text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", epochs: int = EPOCHS) -> Network | None:
    """A network learned from about PER_LANGUAGE rows of each language at most, chosen by a digest of their ids."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null").where(~held_out("id"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # as many rows as the network has outputs
    if not counts:
        return None
    each = max(1, min(PER_LANGUAGE, IN_ALL // len(counts)))
    share = F.from_json(F.lit(json.dumps({x: min(1.0, each / n) for x, n in counts.items()})), "map<string,double>")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, cuts = [], [], []
            for i, t, lang in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                found, _ = windows(t.as_py() or "")
                if len(found):
                    draw = np.random.default_rng([SEED, zlib.crc32(i.encode())]).permutation(len(found))
                    ids.append(i)
                    langs.append(lang)
                    cuts.append(found[np.resize(draw, epochs * PER_EPOCH)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(langs, pa.string()), pa.array(cuts, pa.binary())], ["id", "lang", "bytes"])

    sample = known.where(place < F.element_at(share, F.col("lang"))).select(F.col("id").cast("string").alias("id"), "text", "lang").mapInArrow(cut, "id string, lang string, bytes binary")
    rows = sorted((r["id"], bytes(r["bytes"]), r["lang"]) for r in sample.toLocalIterator())
    languages = sorted({r[2] for r in rows})
    if not languages:
        return None
    number = {x: k for k, x in enumerate(languages)}
    network = Network(languages)
    network.train(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1, WINDOW), np.array([number[r[2]] for r in rows]), epochs)
    return network


def predict_texts(network: Network | None, texts: list[str | None], most: int = 4096) -> tuple[list[str], list[float]]:
    """The language and score of each text; so many windows are looked at together."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        p = network.probabilities(np.concatenate([c for _, c, _ in held]))
        at = 0
        for k, c, sizes in held:
            mean = (p[at : at + len(c)] * sizes[:, None]).sum(axis=0, dtype=np.float64) / sizes.sum(dtype=np.float64)
            at += len(c)
            langs[k], scores[k] = network.languages[int(mean.argmax())], float(min(1.0, mean.max()))
        held.clear()

    n = 0
    for k, t in enumerate(texts):
        if network and t and any(map(str.isalpha, t)):
            cut, sizes = windows(t)
            held.append((k, cut, sizes))
            n += len(cut)
            if n >= most:
                settle()
                n = 0
    if held:
        settle()
    return langs, scores


def identified(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict_texts(network, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, network: Network | None, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language and a score of at least so much."""
    types = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict_texts(network, b.column(text_col).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, types)
