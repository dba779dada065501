"""Substring dedup by difference-cover anchors.

Positions whose remainder modulo PERIOD lies in COVER are anchors. The cover's
differences reach every remainder, so whatever the distance of two equal passages,
some shift below PERIOD puts an anchor at the same place in both. Hashing ANCHOR
words at anchors only (5 of 21 positions) therefore finds every match of
ANCHOR + PERIOD - 1 = 35 words. Around anchors that occur twice, the matches are
extended: all windows of 35 words over such an anchor are hashed in full, and those
that occur twice make up what goes. A window's words have 64 + 32 bits of hash.

A text is known by XXH64 of its bytes, so copies share positions, and a task does the
copies in a chunk once. Each task first merges the hashes of its own chunk: one
row for each distinct hash goes to that hash's group and says whether the chunk has it twice;
the chunk's other places of a hash that it has twice are known to be shared, and go on
as rows of groups of their own. So a group has a row for each chunk at most, however
many documents share the passage, and places are never packed into one row.

The HEAVY texts with most copies are known by a count: their rows lose all words, if
there are enough for a window, and take part in no join, and one copy stands for each in
the second phase. Any other text has no more than 1 / HEAVY of all rows as copies.

Edge cases: a null text has no words; texts below 35 words lose none; repeated
rows and copies of 35 words and more lose all words; kept_sha256 of nothing is that of
the empty string; an empty table gives an empty result. Long texts are one row each
and are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, release
from .words import chunks, encode, grown

#: A perfect difference cover: all remainders modulo 21 are differences of two of these.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
WINDOW = 35
ANCHOR = WINDOW - PERIOD + 1
#: Odd multipliers of the two window hashes, with inverses modulo 2^64.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
PLACES = "h long, g int, tid long, pos int, twice boolean"
#: Texts whose copies are kept out of joins.
HEAVY = 10_000


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(h: np.ndarray, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Of the runs of width word hashes that start at the given places: sums over powers, shifted back."""
    base = _BASES[which]
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, len(h)), dtype=np.uint64)])
    x = (prefix[at + width] - prefix[at]) * _powers(inverse, len(h) + 1)[at]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _merged(h: np.ndarray, g: np.ndarray, tid: np.ndarray, pos: np.ndarray, copied: np.ndarray) -> pa.RecordBatch:
    """One row for each distinct (h, g), with its first place and whether it occurs twice; a row for each other place."""
    order = np.lexsort((pos, tid, g, h))
    h, g, tid, pos = h[order], g[order], tid[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    starts = np.flatnonzero(new)
    twice = np.ones(len(h), bool)
    twice[starts] = (np.diff(np.append(starts, len(h))) > 1) | (np.logical_or.reduceat(copied[order], starts) if len(starts) else False)
    # A place that is known to be shared asks no one: its key is its own, so that they spread.
    own = (tid.view(np.uint64) + pos.astype(np.uint64)) * _BASES[0]
    return pa.RecordBatch.from_arrays([pa.array(np.where(new, h, own).view(np.int64)), pa.array(np.where(new, g, np.int32(-1))), pa.array(tid), pa.array(pos), pa.array(twice)], names=["h", "g", "tid", "pos", "twice"])


def _distinct(tids: np.ndarray, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes | None], np.ndarray]:
    """Each text of a chunk once: its number, its first row, the text, and whether there are copies."""
    tids, first, times = np.unique(tids, return_index=True, return_counts=True)
    return tids, first, [texts[i] for i in first], times > 1


def _word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    codes, offsets, words = encode(texts)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return each[codes], offsets


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    covered = np.isin(np.arange(PERIOD), COVER)
    for batch, texts in chunks(batches, "text"):
        tids, _, texts, copied = _distinct(batch.column("tid").to_numpy(), texts)
        h, offsets = _word_hashes(texts)
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(h)) - offsets[doc]
        at = np.flatnonzero(covered[pos % PERIOD] & (n[doc] >= WINDOW) & (pos <= n[doc] - ANCHOR))
        yield _merged(window_hashes(h, at, ANCHOR), np.zeros(len(at), np.int32), tids[doc[at]], pos[at].astype(np.int32), copied[doc[at]])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All full windows over the shared anchors of each text."""
    for batch, texts in chunks(batches, "text"):
        tids, first, texts, copied = _distinct(batch.column("tid").to_numpy(), texts)
        copied |= batch.column("heavy").to_numpy(zero_copy_only=False)[first]
        h, offsets = _word_hashes(texts)
        spots = batch.column("places").take(pa.array(first)).to_pylist()
        near = np.zeros(len(h) + 1, np.int64)
        for i, own in enumerate(spots):
            p = np.unique(np.array(own, np.int64))
            lo = np.maximum(p - (WINDOW - ANCHOR), 0) + offsets[i]
            hi = np.minimum(p, offsets[i + 1] - offsets[i] - WINDOW) + offsets[i]
            ok = hi >= lo
            np.add.at(near, lo[ok], 1)
            np.add.at(near, hi[ok] + 1, -1)
        at = np.flatnonzero(np.cumsum(near)[: len(h)] > 0)
        doc = np.searchsorted(offsets, at, "right") - 1
        second = (window_hashes(h, at, WINDOW, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        yield _merged(window_hashes(h, at, WINDOW), second, tids[doc], (at - offsets[doc]).astype(np.int32), copied[doc])


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """tid, places: of hashes that occur twice anywhere, each place once."""
    same = Window.partitionBy("h", "g")
    often = rows.withColumn("n", F.count(F.lit(1)).over(same)).where(F.col("twice") | (F.col("n") > 1))
    return materialise(often.groupBy("tid").agg(F.collect_set("pos").alias("places")), name)


def heavy_texts(docs: DataFrame, most: int = HEAVY) -> DataFrame:
    """tid of the texts with most copies (two at least); broadcast, as there are ``most`` at most."""
    counts = docs.where(F.col("text").isNotNull()).groupBy(F.xxhash64("text").alias("tid")).count().where(F.col("count") > 1)
    return F.broadcast(materialise(counts.orderBy(F.desc("count"), "tid").limit(most).select("tid"), "heavy"))


def repeated_windows(docs: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """tid, places: starts of the windows whose words start elsewhere too, by text."""
    heavy = heavy_texts(docs) if heavy is None else heavy
    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("tid"), "text")
    anchors = _shared(texts.mapInArrow(_anchors, PLACES), "anchors")
    # No plan of the first phase is held any more, so its shuffle files can go.
    release(docs.sparkSession)
    once = texts.join(heavy, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text")).withColumn("heavy", F.lit(True))
    once = texts.join(heavy, "tid", "left_anti").withColumn("heavy", F.lit(False)).union(once)
    windows = _shared(once.join(anchors.hint("shuffle_hash"), "tid").mapInArrow(_windows, PLACES), "windows")
    release(docs.sparkSession)
    return windows


def _keep(text: bytes | None, places: np.ndarray | None, heavy: bool) -> tuple[list[bytes], int]:
    words = text.split() if text else []
    if heavy and len(words) >= WINDOW:
        return [], len(words)
    if places is None or not len(places):
        return words, len(words)
    gone = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(places)
    gone[starts] += 1
    np.add.at(gone, starts + WINDOW, -1)
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    return [words[i] for i in kept.tolist()], len(words)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], Iterator[tuple[bool, list[bytes], int]]]]:
    """A chunk, its texts, and of each whether it can have lost words, its kept words and how many it had."""
    for b, texts in chunks(batches, "__text"):
        places = b.column("__places")
        heavy = b.column("__heavy").to_pylist()
        lists = (places[i].values.to_numpy() if places[i].is_valid else None for i in range(b.num_rows))
        yield b, texts, ((p is not None or w, *_keep(t, p, w)) for t, p, w in zip(texts, lists, heavy, strict=True))


def dedup(docs: DataFrame, out: str = "digest", heavy: int = HEAVY) -> DataFrame:
    """docs with repeated words gone.

    out="digest": doc_id, n_words, n_removed, kept_sha256 of every row. out="text": docs'
    own columns, the text of a row that lost words replaced by its kept words, joined by one
    space; other texts stay as they are. Columns of docs may have any names.
    """
    columns = docs.columns
    own = columns if out == "text" else ["doc_id", "text"]
    # Columns go by number on the way, so no name of docs can clash.
    left = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(own) if c != "text"], F.col("text").alias("__text"), F.xxhash64("text").alias("__tid"))
    heavy = heavy_texts(docs, heavy)
    right = repeated_windows(docs, heavy).select(F.col("tid").alias("__tid"), F.col("places").alias("__places"))
    heavy = heavy.withColumnRenamed("tid", "__tid")
    light = left.join(heavy, "__tid", "left_anti").join(right.hint("shuffle_hash"), "__tid", "left").withColumn("__heavy", F.lit(False))
    whole = left.join(heavy, "__tid", "left_semi").withColumn("__places", F.lit(None).cast("array<int>")).withColumn("__heavy", F.lit(True))
    rows = light.unionByName(whole).drop("__tid")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, rows in _cut(batches):
            n, gone, sha = [], [], []
            for _, kept, total in rows:
                n.append(total)
                gone.append(total - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("__0"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts, rows in _cut(batches):
            new = [b" ".join(kept) if marked and len(kept) < total else t for t, (marked, kept, total) in zip(texts, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()).cast(pa.string()) if c == "text" else b.column(f"__{i}") for i, c in enumerate(columns)], names=columns)

    if out == "text":
        return rows.mapInArrow(text, docs.schema)
    return rows.mapInArrow(digest, grown(docs.select("doc_id").schema, "n_words long, n_removed long, kept_sha256 string"))
