"""LM scoring: a log-bilinear model trained by noise-contrastive estimation.

Tokens are words (A-Z lower-cased) and one end for each text. The model predicts a token's
unit from the units of the two before it (before the first stands the end). The TOP commonest words and the end are
units of their own; other words share one of TAIL units by their last byte. The units stand in
GROUPS groups, words with the same last byte side by side, and the softmax has two levels: with q = C1 r1 + C2 r2 from the context's
vectors, P(unit) = P(group | q) P(unit | group, q), each a softmax over vectors and biases of its own, so
that a probability costs two short rows of a matrix product and not one of all units. A shared unit is followed by the
word's share in it, (c + 0.5) / (n + 0.5 (v + 1)), with n tokens and v words of that unit
in training. So a text's log10 probability is proper over
known words and one unknown word for each shared unit.

What is learned covers all training rows: every word's count (a word is kept as 64 bits
of hash), and with it the noise, the shares and which words are units. The vectors are fitted by NCE on the runs of three
units of every training token: few on the driver, many on the executors, whose models are averaged (``train_all``).
The model has a fixed size and is broadcast, as are the HEAD commonest words. Rarer words are
looked up by a join on the hash, which has no hot key, as hot words are in the head.

Edge cases: a null text is empty, one end; with no training row all counts are zero
(N = V = 0), and the base is log10 of 1 for a token; repeated rows are scored each for
itself; an empty table gives an empty result; a null doc_id is not held out; texts of any length are scored in blocks of
BLOCK tokens; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release
from .words import chunks, encode

GROUPS, SLOTS, TAIL = 64, 64, 48
UNITS = GROUPS * SLOTS
TOP = UNITS - 1 - TAIL
END = TOP
HEAD = 1 << 17
#: Tokens whose rows of the softmax are held at once.
BLOCK = 1 << 14
#: Tokens that a task shuffles at once in training, and pieces in which models are summed.
HELD, PIECES = 1 << 18, 64


def keep_freed() -> None:
    """Arrays of each step take the memory of the step before. glibc keeps freed blocks of up to the largest that was freed; others would be mapped, page by page, again and again."""
    np.empty(1 << 24, np.uint8)


def tail_class(last: int) -> int:
    """Of a word by its last byte: letters apart, other ASCII in 6, other bytes in 16 classes."""
    lower = last | 32
    return TOP + 1 + (lower - 97 if 97 <= lower <= 122 else 26 + last % 6 if last < 128 else 32 + last % 16)


def _hashes(words: list[bytes]) -> np.ndarray:
    """The end is the empty word, which no text holds."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(codes with an end after each text, offsets, distinct tokens; the last one is the end)."""
    codes, offsets, words = encode(texts, lower=True)
    codes = np.insert(codes, offsets[1:], len(words)).astype(np.int32)
    return codes, offsets + np.arange(len(offsets)), [*words, b""]


def units_of(words: list[bytes], top: dict[int, int], hashes: np.ndarray) -> np.ndarray:
    """top: unit by hash, for words with a unit of their own."""
    own = [top.get(h) for h in hashes.tolist()]
    return np.array([c if c is not None else END if not w else tail_class(w[-1]) for c, w in zip(own, words, strict=True)], np.int64)


def contexts(k: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: the units just before it and before that, ends before the first."""
    one, two = np.roll(k, 1), np.roll(k, 2)
    one[offsets[:-1]] = END
    two[offsets[:-1]] = END
    second = offsets[:-1] + 1
    two[second[second < offsets[1:]]] = END
    return one, two


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), tail (class by last byte; END for the end), n: of all tokens of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, "text"):
            codes, _, words = tokens_of(texts)
            tail = [tail_class(w[-1]) if w else END for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(words)), pa.array(tail, pa.int32()), pa.array(np.bincount(codes, minlength=len(words)))], names=["word", "tail", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, tail int, n long")
    return rows.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def coded(docs: DataFrame, top: dict[int, int]) -> DataFrame:
    """units: of each row, all its tokens' units and the end, 16 bits each."""
    shared = docs.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, "text"):
            codes, offsets, words = tokens_of(texts)
            k = units_of(words, shared.value, _hashes(words))[codes].astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([k[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())], names=["units"])

    return docs.select("text").mapInArrow(run, "units binary")


def runs_of(cells: list[bytes]) -> np.ndarray:
    """A run, three units as one number, for every token of coded texts."""
    k = np.frombuffer(b"".join(cells), "<u2").astype(np.int64)
    one, two = contexts(k, np.cumsum([0, *(len(c) // 2 for c in cells)]))
    return (two * UNITS + one) * UNITS + k


def places(last: np.ndarray) -> np.ndarray:
    """Each unit's place, group * SLOTS + slot: units in order of their words' tail class, then of their number."""
    out = np.empty(len(last), np.int64)
    out[np.lexsort((np.arange(len(last)), last))] = np.arange(len(last))
    return out


@dataclass
class LogBilinear:
    near: np.ndarray  # vectors of the unit just before
    far: np.ndarray  # of the one before that
    mix: tuple[np.ndarray, np.ndarray]  # C1, C2
    group: np.ndarray  # GROUPS x dim
    group_bias: np.ndarray
    unit: np.ndarray  # by place: UNITS x dim
    unit_bias: np.ndarray
    place: np.ndarray  # of each unit

    def logs(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 probabilities of units after their contexts."""
        near, far = self.near @ self.mix[0], self.far @ self.mix[1]
        bias = self.unit_bias.reshape(GROUPS, SLOTS)
        out = np.empty(len(w), np.float64)
        for lo in range(0, len(w), BLOCK):
            part = slice(lo, lo + BLOCK)
            order, g, slot = _by_group(self.place[w[part]])
            q = near.take(one[part][order], 0)
            q += far.take(two[part][order], 0)
            z = q @ self.group.T
            z += self.group_bias
            here = _picked(z, g)
            for own, of in _blocks(g):
                np.matmul(q[own], self.unit[of].T, out=z[own])
                z[own] += bias[of.start // SLOTS]
            here += _picked(z, slot)
            out[part][order] = here
        return out / np.log(10)


def _by_group(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by group, groups and slots in that order) of places: products with a group's units are then of dense blocks."""
    order = np.argsort((at // SLOTS).astype(np.uint8), kind="stable")
    at = at[order]
    return order, at // SLOTS, at % SLOTS


def _blocks(g: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """(rows, places of their group's units) for each group in g, which is in order."""
    edges = np.searchsorted(g, np.arange(GROUPS + 1)).tolist()
    for i, (a, b) in enumerate(itertools.pairwise(edges)):
        if a < b:
            yield slice(a, b), slice(i * SLOTS, (i + 1) * SLOTS)


def _picked(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row at one place; z is overwritten."""
    if max(z.max(), -z.min()) > 60:
        # Some exponential might not fit 32 bits.
        z -= z.max(1, keepdims=True)
    own = z[np.arange(len(z)), k].astype(np.float64)
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def _scattered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values' rows by number."""
    dim = values.shape[1]
    return np.bincount((rows[:, None] * dim + np.arange(dim)).ravel(), values.ravel(), n * dim).reshape(n, dim)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Noise:
    """What noise is drawn from: the units' shares of all training tokens, by place."""

    place: np.ndarray
    group_share: np.ndarray
    unit_share: np.ndarray  # of its group
    group_sums: np.ndarray
    # Alias tables of each group's slots: a slot stands with this chance, else its other slot of the group does.
    stays: np.ndarray
    other: np.ndarray

    def groups(self, rng: np.random.Generator) -> np.ndarray:
        """How often each group is drawn, in GROUPS draws."""
        return np.bincount(np.minimum(np.searchsorted(self.group_sums, rng.random(GROUPS)), GROUPS - 1), minlength=GROUPS)

    def slots(self, g: np.ndarray, few: int, rng: np.random.Generator) -> np.ndarray:
        """few rows of slots, one for each group of g, by their shares of that group."""
        slot = rng.integers(0, SLOTS, (few, len(g)))
        at = slot + g * SLOTS
        moved = rng.random(at.shape) >= self.stays.take(at)
        slot[moved] = self.other.take(at[moved])
        return slot


def _aliases(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walker's alias tables of rows of shares, each of which adds up to 1."""
    left, other = shares * shares.shape[1], np.tile(np.arange(shares.shape[1]), (len(shares), 1))
    for own, to in zip(left, other, strict=True):
        low, high = (list(np.flatnonzero(x)) for x in (own < 1, own >= 1))
        while low and high:
            i, j = low.pop(), high[-1]
            to[i] = j
            own[j] -= 1 - own[i]
            if own[j] < 1:
                low.append(high.pop())
        # What rounding has left over stands for itself.
        own[[*low, *high]] = 1
    return left.ravel(), other.ravel()


def noise_of(n: np.ndarray, last: np.ndarray) -> Noise:
    """n: the units' counts; a unit that no training token has gets half a count. last: the tail class of each unit's word."""
    place = places(last)
    by_place = np.empty(UNITS)
    by_place[place] = n + 0.5
    sums = by_place.reshape(GROUPS, SLOTS).sum(1)
    group_share, unit_share = sums / sums.sum(), by_place / np.repeat(sums, SLOTS)
    return Noise(place, group_share, unit_share, np.cumsum(group_share), *_aliases(unit_share.reshape(GROUPS, SLOTS)))


def started(shares: Noise, rng: np.random.Generator, dim: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(parameters, their mean squared gradients) before the first step."""
    near, far, unit = (rng.normal(0, 0.1, (UNITS, dim)) for _ in range(3))
    group = rng.normal(0, 0.1, (GROUPS, dim))
    params = [p.astype(np.float32) for p in (near, far, np.eye(dim), np.eye(dim), group, np.log(shares.group_share), unit, np.log(shares.unit_share))]
    return params, [np.full_like(p, 1e-8) for p in params]


def stepped(params: list[np.ndarray], squares: list[np.ndarray], drawn: np.ndarray, shares: Noise, rng: np.random.Generator, rate: float, noise: int, few: int) -> None:
    """One step of NCE at both levels, in place: a real group against noise groups, a real unit against noise units of its group."""
    near, far, c1, c2, group, group_bias, unit, unit_bias = params
    batch = len(drawn)
    order, g, slot = _by_group(shares.place[drawn % UNITS])
    one, two = drawn[order] // UNITS % UNITS, drawn[order] // UNITS**2
    a, b, rows = near.take(one, 0), far.take(two, 0), np.arange(batch)
    q = a @ c1 + b @ c2
    # Groups: all examples of a batch share the noise, so its products are dense.
    z = q @ -group.T
    z += np.log(noise * shares.group_share).astype(np.float32) - group_bias
    real = _sigmoid(z[rows, g]) / -batch
    # The sigmoids in place: an exponential that doesn't fit stands for zero.
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    np.divide((shares.groups(rng) * (noise / GROUPS / batch)).astype(np.float32), z, out=z)
    z[rows, g] += real
    dq, d_group, d_group_bias = z @ group, z.T @ q, np.ones(batch, np.float32) @ z
    # Units: noise from the real unit's own group.
    blocks = list(_blocks(g))
    for own, of in blocks:
        np.matmul(q[own], unit[of].T, out=z[own])
    slots = np.concatenate([slot[None], shares.slots(g, few, rng)])
    at, places = slots + rows * SLOTS, slots + g * SLOTS
    x = z.take(at) + (unit_bias - np.log(few * shares.unit_share).astype(np.float32)).take(places)
    x[0] *= -1
    x = _sigmoid(x) / batch
    x[0] *= -1
    z.fill(0)
    flat = z.reshape(-1)
    for i, v in zip(at, x, strict=True):
        flat[i] += v
    d_unit, d_unit_bias, more = np.zeros_like(unit), np.bincount(places.ravel(), x.ravel(), UNITS), np.empty_like(dq)
    for own, of in blocks:
        np.matmul(z[own], unit[of], out=more[own])
        np.matmul(z[own].T, q[own], out=d_unit[of])
    dq += more
    grads = [_scattered(one, dq @ c1.T, UNITS), _scattered(two, dq @ c2.T, UNITS), a.T @ dq, b.T @ dq, d_group, d_group_bias, d_unit, d_unit_bias]
    for p, d, sq in zip(params, grads, squares, strict=True):
        d = d.astype(np.float32, copy=False)
        x = d * d
        x *= np.float32(0.01)
        sq *= np.float32(0.99)
        sq += x
        np.sqrt(sq, out=x)
        x += np.float32(1e-7)
        np.divide(d, x, out=x)
        x *= np.float32(rate)
        p -= x


def fitted(params: list[np.ndarray], shares: Noise) -> LogBilinear:
    near, far, c1, c2, *rest = (p.astype(np.float32) for p in params)
    return LogBilinear(near, far, (c1, c2), *rest, shares.place)


def train(runs: np.ndarray, n: np.ndarray, last: np.ndarray, dim: int = 16, noise: int = 24, few: int = 4, batch: int = 4096, steps: int = 800, epochs: int = 8, seed: int = 11) -> LogBilinear:
    """The model of few runs, drawn again and again."""
    keep_freed()
    rng = np.random.default_rng(seed)
    # Few runs aren't gone over so often that they are learned by heart.
    steps = min(steps, -(-epochs * len(runs) // batch))
    shares = noise_of(n, last)
    params, squares = started(shares, rng, dim)
    for step in range(steps):
        stepped(params, squares, runs[rng.integers(0, len(runs), batch)], shares, rng, 0.3 * (0.1 * (1 - step / steps) + 0.005), noise, few)
    if not len(runs):
        for k in (0, 1, 4, 6):
            params[k] *= 0
    return fitted(params, shares)


def train_all(cells: DataFrame, n: np.ndarray, last: np.ndarray, dim: int = 16, noise: int = 24, few: int = 4, batch: int = 4096, rounds: int = 8, seed: int = 11) -> LogBilinear:
    """The model of all tokens of coded texts, each of which is learned from once.

    In each round every task goes over its next share of texts, from the model of the round before; the mean of the
    tasks' models, weighted by their tokens, is that of the round. It is summed by pieces in a shuffle, so
    the driver gets one model a round, whatever the number of tasks.
    """
    sc = cells.sparkSession.sparkContext
    shares = noise_of(n, last)
    params, squares = started(shares, np.random.default_rng(seed), dim)
    for r in range(rounds):
        shared = sc.broadcast((params, squares, shares))
        rate = 0.3 * (0.1 * (1 - (r + 0.5) / rounds) + 0.005)

        def learn(batches: Iterator[pa.RecordBatch], r=r, shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            keep_freed()
            old, old_squares, shares = shared.value
            params, squares = [p.copy() for p in old], [p.copy() for p in old_squares]
            rng = np.random.default_rng((seed, r, TaskContext.get().partitionId()))
            seen, row, held, size = 0, 0, [], 0
            for b in itertools.chain(batches, [None]):
                if b is not None:
                    new = b.column("units").slice((r - row) % rounds).to_pylist()[::rounds]
                    row += b.num_rows
                    held += new
                    size += sum(map(len, new)) // 2
                if held and (b is None or size >= HELD):
                    runs = rng.permutation(runs_of(held))
                    for drawn in np.array_split(runs, -(-len(runs) // batch)):
                        stepped(params, squares, drawn, shares, rng, rate, noise, few)
                    seen, held, size = seen + size, [], 0
            if seen:
                flat = np.array_split(np.concatenate([p.ravel() for p in (*params, *squares)]), PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([seen] * PIECES, pa.int64()), pa.array([x.tobytes() for x in flat], pa.binary())], names=["piece", "n", "x"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for piece, m, x in zip(*(b.column(c).to_pylist() for c in ("piece", "n", "x")), strict=True):
                    own = sums.setdefault(piece, [0, 0.0])
                    own[0] += m
                    own[1] = own[1] + m * np.frombuffer(x, np.float32).astype(np.float64)
            rows = sorted((p, m, x.tobytes()) for p, (m, x) in sums.items())
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["piece", "n", "x"])

        shape = "piece int, n long, x binary"
        got = cells.mapInArrow(learn, shape).repartition("piece").mapInArrow(summed, shape).toArrow().sort_by("piece")
        flat = np.concatenate([np.frombuffer(x, np.float64) / m for x, m in zip(got.column("x").to_pylist(), got.column("n").to_pylist(), strict=True)]).astype(np.float32)
        ends = np.cumsum([p.size for p in (*params, *squares)])
        parts = [x.reshape(p.shape) for x, p in zip(np.split(flat, ends[:-1]), (*params, *squares), strict=True)]
        params, squares = parts[: len(params)], parts[len(params) :]
        shared.unpersist()
    return fitted(params, shares)


@dataclass
class Model:
    total: int
    distinct: int
    head: np.ndarray  # hashes, in order
    head_logs: np.ndarray  # log10 (c + 0.5)
    top: dict[int, int]
    units: LogBilinear
    unit_logs: np.ndarray  # log10 of each shared unit's denominator, zero elsewhere


def fit(docs: DataFrame, local: int = 1 << 20, part: int = 1 << 21, **options) -> tuple[Model, DataFrame]:
    """The model of all rows of docs, and their word counts (word, n).

    Up to ``local`` tokens are learned from on the driver, more on the executors in parts of about ``part`` tokens.
    """
    counts = materialise(count_words(docs), "words")
    release(docs.sparkSession)
    sums = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = int(sums[0] or 0)
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow().to_pandas()
    end = int(_hashes([b""])[0])
    words = head[head.word != end].head(TOP)
    top = {int(w): i for i, w in enumerate(words.word)}
    # The words with units of their own are no more than the head, which is broadcast anyway.
    own = docs.sparkSession.createDataFrame([(w,) for w in [*top, end]], "word long")
    shared = counts.join(F.broadcast(own), "word", "left_anti").groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow().to_pandas()
    unit_logs, n, last = np.zeros(UNITS), np.zeros(UNITS), np.full(UNITS, TAIL)
    unit_logs[TOP + 1 :] = np.log10(0.5)
    unit_logs[shared["tail"]] = np.log10(shared["n"] + 0.5 * (shared["v"] + 1))
    n[: len(words)], n[END], n[shared["tail"]] = words.n, head.n[head.word == end].sum(), shared["n"]
    last[: len(words)], last[TOP + 1 :] = words["tail"] - TOP - 1, np.arange(TAIL)
    cells = coded(docs, top)
    if total <= local:
        units = train(np.sort(runs_of(cells.toArrow().column("units").to_pylist())), n, last, **options)
    else:
        units = train_all(materialise(cells.repartition(-(-total // part)), "units"), n, last, **options)
        release(docs.sparkSession)
    head = head.sort_values("word")
    model = Model(total, int(sums[1]), head.word.to_numpy(np.int64), np.log10(head.n.to_numpy(float) + 0.5), top, units, unit_logs)
    return model, counts.select("word", "n")


def _partial(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document: what the head and the units tell, and the words to look up."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        m, part, row = shared.value, TaskContext.get().partitionId(), 0
        for batch, texts in chunks(batches, "text"):
            codes, offsets, words = tokens_of(texts)
            hashes = _hashes(words)
            at = np.searchsorted(m.head, hashes)
            known = at < len(m.head)
            known[known] = m.head[at[known]] == hashes[known]
            logs = np.zeros(len(words))
            logs[known] = m.head_logs[at[known]]
            k = units_of(words, m.top, hashes)
            ks = k[codes]
            here = m.units.logs(ks, *contexts(ks, offsets)) - m.unit_logs[ks]
            own = np.where(k > END, logs, 0.0)[codes]
            starts = offsets[:-1]
            sums = [np.add.reduceat(x, starts) if len(starts) else x for x in (here + own, logs[codes], known[codes].astype(np.int64))]
            rare, times = [], []
            for a, b in zip(starts, offsets[1:], strict=True):
                c, n = np.unique(codes[a:b][~known[codes[a:b]]], return_counts=True)
                rare.append(hashes[c])
                times.append(n)
            ends = np.cumsum([0, *map(len, rare)], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64))) for x in (rare, times)]
            rows = np.arange(row, row + len(texts)) + (part << 40)
            row += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows), pa.array(np.diff(offsets)), *map(pa.array, sums), *lists], names=["doc_id", "row", "n_tokens", "model", "base", "known", "rare", "times"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, row long, n_tokens long, model double, base double, known long, rare array<long>, times array<long>")


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    # Written once: the join below must see the row numbers that the rows themselves carry.
    partial = materialise(_partial(docs, model), "scores")
    release(docs.sparkSession)
    rare = partial.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    both = partial.drop("rare", "times").join(sums, "row", "left")
    log, known = F.coalesce("rare_log", F.lit(0.0)), F.col("known") + F.coalesce("rare_known", F.lit(0))
    total = F.lit(model.total).cast("long")
    base = F.col("base") + log - F.col("n_tokens") * F.lit(float(np.log10(model.total + 0.5 * (model.distinct + 1))))
    return both.select("doc_id", "n_tokens", known.alias("n_known"), total.alias("train_tokens"), base.alias("base_score"), (F.col("model") + log).alias("score"))


def train_and_score(docs: DataFrame, in_training: Column) -> DataFrame:
    model, counts = fit(docs.where(in_training))
    return score(docs, model, counts)
