"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1. For each bit a binary classifier
(logistic regression over hashed byte n-grams) tells whether the text belongs to
the languages with +1 there. Decoding adds up the logistic losses of a codeword's
bits, each weighted by how reliably that bit's classifier served that language in
training, and picks the nearest codeword. A text whose two nearest codewords are
close together is flagged as ambiguous.

Only the fit sees languages, on a bounded sample of the training rows (``per_lang``
rows for each of the ``max_langs`` commonest languages); predictions read whole texts.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is
every text where nothing could be learned; with one language learned, that one
is predicted. Repeated rows get the same result; an empty table an empty one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import chunks, fresh, grown

DIM = 4096
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Letters of ASCII in lower case, other ASCII as one kind of gap, bytes of other characters as they are.
_KIND = np.array([c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256)], np.uint32)
#: Rows of the feature matrix held at once.
ROWS = 512


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    trust: np.ndarray  # languages x bits, each row adds up to 1
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray


def codebook(k: int, max_bits: int = 31, seed: int = 3) -> np.ndarray:
    """All 2^(k-1)-1 splits of k classes where these are few; else the best of random ones by least distance."""
    if k < 2:
        return np.ones((k, 1))
    if 2 ** (k - 1) - 1 <= max_bits:
        return np.array([[1.0, *s] for s in itertools.product((1.0, -1.0), repeat=k - 1)][1:]).T
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        book = rng.choice((-1.0, 1.0), (k, max_bits))
        gram = book @ book.T - 2 * max_bits * np.eye(k)
        if (np.abs(book.sum(0)) < k).all() and max_bits - gram.max() > most:
            best, most = book, max_bits - gram.max()
    return best


def grams(texts: list[bytes | None]) -> np.ndarray:
    """Rows of square roots of shares of hashed bigrams and trigrams (unit length; zero rows for empty texts)."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        if not t:
            continue
        a = _KIND[np.frombuffer(b" %b " % t, np.uint8)]
        pair = a[:-1] * 257 + a[1:]
        triple = pair[:-1] * 263 + a[2:]
        ids = np.concatenate([(pair * np.uint32(2654435761)) >> 21, 2048 + ((triple * np.uint32(2246822519)) >> 21)])
        out[i] = np.sqrt(np.bincount(ids, minlength=DIM) / len(ids))
    return out


def fit(x: np.ndarray, langs: list[str], y: np.ndarray, steps: int = 150) -> Model:
    """Adam on all rows at once, every bit beside the others."""
    codes = codebook(len(langs))
    if len(langs) < 2:
        return Model(langs, codes, np.ones_like(codes), np.zeros((DIM, 1), np.float32), np.ones(1, np.float32))
    target = codes[y].astype(np.float32)
    each = (len(y) / len(langs) / np.bincount(y, minlength=len(langs)))[y][:, None].astype(np.float32) / len(y)
    w, b = np.zeros((DIM, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -60, 60))) * each
        dw, db = x.T @ g + 1e-6 * w, g.sum(0)
        m, s, mb, sb = 0.9 * m + 0.1 * dw, 0.99 * s + 0.01 * dw**2, 0.9 * mb + 0.1 * db, 0.99 * sb + 0.01 * db**2
        rate = 0.5 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(s) + 1e-8)
        b -= rate * mb / (np.sqrt(sb) + 1e-8)
    right = (np.sign(x @ w + b) == target).astype(float)
    trust = np.stack([right[y == i].mean(0) for i in range(len(langs))]) + 1e-3
    return Model(langs, codes, trust / trust.sum(1, keepdims=True), w, b)


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest codeword, its share in 0..1, lead over the next) of each row."""
    f = x @ model.weights + model.bias
    loss = np.stack([(np.logaddexp(0, -f * c) * t).sum(1) for c, t in zip(model.codes, model.trust, strict=True)], 1)
    p = np.exp((loss.min(1, keepdims=True) - loss) * model.codes.shape[1])
    p /= p.sum(1, keepdims=True)
    order = np.sort(p, 1)
    lead = order[:, -1] - order[:, -2] if p.shape[1] > 1 else np.ones(len(p))
    return loss.argmin(1), p.max(1), lead


def train(docs: DataFrame, in_training: Column, per_lang: int = 500, max_langs: int = 256) -> Model:
    """Fit on per_lang rows or so of every language, drawn by a hash of doc_id: the documented bound."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training)
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return Model([], np.zeros((0, 1)), np.zeros((0, 1)), np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    parts = [(F.col("lang") == r["lang"]) & (draw < int(min(1, per_lang / r["count"]) * (1 << 30))) for r in counts]
    sample = known.where(F.reduce(F.array(*parts), F.lit(False), lambda a, b: a | b)).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            for lo in range(0, len(texts), ROWS):
                x = grams(texts[lo : lo + ROWS]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = sample.mapInArrow(run, "lang string, x binary").toArrow().to_pandas().sort_values(["lang", "x"])
    if got.empty:
        return fit(np.zeros((0, DIM), np.float32), langs[:1], np.zeros(0, int))
    seen = sorted(set(got.lang))
    x = np.stack([np.frombuffer(r, np.float16) for r in got.x]).astype(np.float32)
    return fit(x, seen, got.lang.map(seen.index).to_numpy())


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous"), least_lead: float = 0.2) -> DataFrame:
    """The carried columns and, under the given names, language, score and whether it is ambiguous, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = list(carry)
    rows = docs.select(*[f"`{c}`" for c in dict.fromkeys([*carry, "text"])])
    schema = grown(docs.select(*[f"`{c}`" for c in carry]).schema, f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in chunks(batches, "text"):
            langs, scores, doubt = [], [], []
            for lo in range(0, len(texts), ROWS):
                part = texts[lo : lo + ROWS]
                letters = [bool(t) and bool(m.langs) and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in part]
                best, share, lead = decode(m, grams(part)) if m.langs else (np.zeros(len(part), int), np.zeros(len(part)), np.zeros(len(part)))
                langs += [m.langs[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]
                scores += [float(s) if ok else 0.0 for s, ok in zip(share, letters, strict=True)]
                doubt += [not ok or bool(d < least_lead) for d, ok in zip(lead, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt)], names=[*carry, *names])

    return rows.mapInArrow(run, schema)


def known_language(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that have no language (null texts, no letter); its columns stay as they are.

    Where no row has a language to learn from, texts with a letter are kept.
    """
    names = tuple(fresh(docs.columns, "lang_pred", "score", "ambiguous"))
    model = train(docs, F.lit(True), **options)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, model, tuple(docs.columns), names)
    return found.where(F.col(names[0]) != UNKNOWN).select(*[f"`{c}`" for c in docs.columns])
