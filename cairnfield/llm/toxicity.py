"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words, lower-cased and stripped of punctuation,
and their leading five characters, hashed to 64 bits; a term's value is 1. The
score is the logistic of w0 + sum w_i + sum_{i<j} <v_i, v_j>, whose pairwise part
takes one pass: half of |sum v_i|^2 - sum |v_i|^2.

A term has weight and factors if the sample holds it in ``min_docs`` documents or more
and it tells the classes apart, alone or together with another term; the rest is noise, which
would add up in long texts. Alone: its share of positive documents is off by ``min_gap``
deviations. Together: among documents that hold it and one of the ``pair_terms`` commonest terms, the
share is off by ``pair_gap`` deviations from what both terms' own shares make it when their log
odds add up. So members of an exclusive or, which tell nothing alone, are kept. The kept terms are
at most ``max_terms``, the broadcast's bound.

Only the fit sees labels, on a bounded sample of the labelled training rows; the
scores cover every whole text.

Edge cases: a null or empty text has no terms and scores the bias alone; a
null doc_id belongs to no label and counts as held out only by the contract's
remainder (null: false); repeated rows score alike; with no labelled row, or one
class only, the bias is the class's log odds with add-one smoothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import chunks, encode

#: Bytes stripped from both ends of a word: ASCII punctuation.
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STEM = 5


@dataclass
class Model:
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    bias: float = 0.0
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((1, 4), np.float32))


def _hash(word: bytes) -> tuple[int, int]:
    import xxhash

    word = word.strip(EDGES).decode("utf-8", "replace").lower()
    return xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(f"^{word[:STEM]}")


def terms_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed terms of every text, one after the other; offsets)."""
    codes, offsets, words = encode(texts)
    hashed = np.array([_hash(w) for w in words], np.uint64).reshape(-1, 2)
    parts = [np.unique(hashed[np.unique(codes[a:b])]) for a, b in zip(offsets, offsets[1:], strict=False)]
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, parts)])


def logits(model: Model, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unknown terms map to an extra index whose weight and factors are zero."""
    n = len(model.terms)
    at = np.searchsorted(model.terms, terms)
    known = at < n
    known[known] = model.terms[at[known]] == terms[known]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[known]
    at = at[known]
    linear = np.bincount(row, model.weight[at], len(offsets) - 1)
    v = model.factors[at]
    pairs = np.zeros(len(offsets) - 1)
    for f in range(model.factors.shape[1]):
        pairs += np.bincount(row, v[:, f], len(offsets) - 1) ** 2 - np.bincount(row, v[:, f] ** 2, len(offsets) - 1)
    return model.bias + linear + pairs / 2


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def apart(positive: np.ndarray, docs: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """By how many deviations the positive documents of some differ from a share of them."""
    return np.abs(positive - docs * share) / np.sqrt(docs * share * (1 - share) + 1)


def pair_gaps(ids: np.ndarray, row: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Of m terms, each with any other: the greatest distance from what both tell when their log odds add up.

    (row, id) says that a document holds a term. Tables of m columns are made for 256 terms at a time.
    """
    held = np.zeros((len(y), m), np.float32)
    held[row, ids] = 1

    def odds(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.log((p + 0.5) / (n - p + 0.5))

    docs, positive = held.sum(0), y.astype(np.float32) @ held
    own = odds(positive, docs) - odds(y.sum(), len(y))
    out = np.zeros(m)
    for lo in range(0, m, 256):
        part = held[:, lo : lo + 256]
        both = part.T @ held
        hits = (part * y[:, None].astype(np.float32)).T @ held
        share = sigmoid(odds(y.sum(), len(y)) + own[lo : lo + 256, None] + own[None])
        gap = apart(hits, both, share)
        gap[np.arange(len(gap)), lo + np.arange(len(gap))] = 0
        # Words that go together always, as a word and its stem do, are one term and tell nothing as a pair.
        gap[both >= 0.9 * np.minimum(docs[lo : lo + 256, None], docs[None])] = 0
        out[lo : lo + 256] = gap.max(1)
    return out


def fit(terms: np.ndarray, offsets: np.ndarray, y: np.ndarray, min_docs: int = 3, min_gap: float = 3.0, pair_gap: float = 6.0, pair_terms: int = 2048, max_terms: int = 1 << 17, rank: int = 4, epochs: int = 30, seed: int = 7) -> Model:
    """AdaGrad over minibatches of documents; terms are ordered by how well they separate the classes."""
    n = len(y)
    prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if n == 0 or y.min() == y.max():
        return Model(bias=prior)
    kinds, inverse, docs = np.unique(terms, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), np.diff(offsets))
    positive = np.bincount(inverse, y[row], len(kinds))
    share = y.mean()
    gap = apart(positive, docs, share)
    common = np.argsort(-np.where(docs < n, docs, 0), kind="stable")[:pair_terms]
    place = np.full(len(kinds), -1)
    place[common] = np.arange(len(common))
    some = place[inverse] >= 0
    pairs = np.zeros(len(kinds))
    pairs[common] = pair_gaps(place[inverse[some]], row[some], y, len(common))
    keep = np.flatnonzero((docs >= min_docs) & ((gap >= min_gap) | (pairs >= pair_gap)))
    gap = np.maximum(gap / min_gap, pairs / pair_gap)
    keep = np.sort(keep[np.argsort(-gap[keep], kind="stable")[:max_terms]])
    new = np.full(len(kinds), -1)
    new[keep] = np.arange(len(keep))
    ids = new[inverse]
    row, ids = row[ids >= 0], ids[ids >= 0]
    starts = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(keep)), rng.normal(0, 0.01, (len(keep), rank)), prior
    gw, gv, gb = np.full(len(keep), 1e-6), np.full((len(keep), rank), 1e-6), 1e-6
    # Both classes weigh alike half-way, so that a rare one isn't drowned.
    cost = np.where(y > 0, np.sqrt((1 - share) / share), 1.0)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            batch = order[lo : lo + 64]
            sizes = starts[batch + 1] - starts[batch]
            at = np.repeat(starts[batch] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            i, r = ids[at], np.repeat(np.arange(len(batch)), sizes)
            sums = np.zeros((len(batch), rank))
            np.add.at(sums, r, v[i])
            z = b + np.bincount(r, w[i], len(batch)) + ((sums**2).sum(1) - np.bincount(r, (v[i] ** 2).sum(1), len(batch))) / 2
            g = (sigmoid(z) - y[batch]) * cost[batch] / len(batch)
            used, slot = np.unique(i, return_inverse=True)
            dw = np.bincount(slot, g[r], len(used)) + 1e-5 * w[used]
            each = g[r][:, None] * (sums[r] - v[i])
            dv = 1e-5 * v[used]
            for f in range(rank):
                dv[:, f] += np.bincount(slot, each[:, f], len(used))
            gw[used] += dw**2
            gv[used] += dv**2
            gb += g.sum() ** 2
            w[used] -= 0.2 * dw / np.sqrt(gw[used])
            v[used] -= 0.02 * dv / np.sqrt(gv[used])
            b -= 0.05 * g.sum() / np.sqrt(gb)
    return Model(kinds[keep], b, w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, in_training: Column, max_rows: int = 8_000, **options) -> Model:
    """Fit on max_rows labelled training rows or so: documented bound of the sample, by a hash of doc_id.

    The sampled labels are broadcast (max_rows bounds them), so texts aren't shuffled.
    The driver gets hashed terms only, whatever the texts' lengths.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & in_training).select(F.col("doc_id"), F.col("toxic").cast("double").alias("y"))
    total = known.count()
    part = min(1.0, max_rows / max(total, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            terms, offsets = terms_of(texts)
            rows = [terms[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y"), pa.array(rows, pa.binary())], names=["doc_id", "y", "terms"])

    got = sample.mapInArrow(run, "doc_id long, y double, terms binary").toArrow().to_pandas().sort_values(["doc_id", "terms"]).reset_index(drop=True)
    parts = [np.frombuffer(x, np.uint64) for x in got.terms]
    return fit(np.concatenate([*parts, np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, parts)]), got.y.to_numpy(float), **options)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            p = sigmoid(logits(shared.value, *terms_of(texts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
