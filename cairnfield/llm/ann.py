"""Nearest neighbours by score-aware (anisotropic) quantisation.

The nearest vector in Euclidean distance is that of the greatest inner product
q.x - |x|^2/2, so the search is one for greatest inner products. A vector is cut
into two-dimensional subspaces, each coded with 4 bits. Codes and codebook are
fitted to a loss in which the residual's part along the vector, the one that
disturbs great inner products, weighs ``eta`` times as much as the rest. A
query makes a table of 16 products for each subspace; two tables make one of 256
for a byte of codes, and a candidate's score is a sum of look-ups plus its exact
norm. The best ``rerank`` of every block get exact distances in double precision, and so do all others that the
tables' error leaves in reach of the k-th: in a crowd of near-equal vectors that is the crowd.

Queries meet all candidates, in blocks of bounded size. Of equal vectors only the
k + 1 smallest ids can be among a query's k nearest (ties go to the smaller id),
so the others needn't be searched; nothing is lost by that.

Edge cases: vectors that are null, zero, or hold a null or a non-finite component
take no part, nor do rows without an id or of another length than the
commonest; repeated rows count once; with fewer than k candidates all are returned. Of several
vectors under one id, the smallest, by components in order, asks; all of them are candidates of other ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import grown

WIDTH, CODES = 2, 16
NEAREST = "query_id long, vec_id long, score double"


@dataclass
class Codebook:
    dim: int
    centres: np.ndarray  # subspaces x CODES x WIDTH
    eta: float
    slack: float = 0.0  # by which a squared distance from tables may be too great: three deviations


def padded(x: np.ndarray) -> np.ndarray:
    """Zero columns up to a multiple of two subspaces, for whole bytes of codes."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * WIDTH))))


def assign(x: np.ndarray, book: Codebook, codes: np.ndarray | None = None, rounds: int = 2) -> np.ndarray:
    """Codes by coordinate descent: one subspace at a time, the others' residual along x held."""
    parts = x.reshape(len(x), -1, WIDTH)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(parts.shape)
    residual = parts[:, :, None] - book.centres[None]  # rows x subspaces x codes x width
    square = (residual**2).sum(3)
    along = (residual * unit[:, :, None]).sum(3)
    if codes is None:
        codes = square.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(rounds):
        for j in range(parts.shape[1]):
            rest = total - along[rows, j, codes[:, j]]
            codes[:, j] = (square[:, j] + (book.eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            total = rest + along[rows, j, codes[:, j]]
    return codes


def train(x: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 5) -> Codebook:
    """Alternates codes and centres; a centre solves a 2 x 2 system of its members."""
    dim, x = x.shape[1], padded(x.astype(np.float64))
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    parts = x.reshape(len(x), -1, WIDTH)
    rng = np.random.default_rng(seed)
    book = Codebook(dim, np.stack([parts[rng.integers(0, len(x), CODES), j] for j in range(parts.shape[1])]), 1.0)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(parts.shape)
    for step in range(2 * rounds):
        book.eta = 1.0 if step < rounds else eta  # plain k-means first
        codes = assign(x, book, rounds=1 if step >= rounds else 0)
        for j in range(parts.shape[1]):
            chosen = np.take_along_axis(book.centres, codes.T[:, :, None], 1).transpose(1, 0, 2)
            along = ((parts - chosen) * unit).sum(2)
            rest = along.sum(1) - along[:, j]
            u, v = unit[:, j], parts[:, j]
            rhs = v + (book.eta - 1) * u * (rest + (u * v).sum(1))[:, None]
            outer = np.eye(WIDTH) + (book.eta - 1) * u[:, :, None] * u[:, None, :]
            for c in range(CODES):
                own = codes[:, j] == c
                if own.any():
                    book.centres[j, c] = np.linalg.solve(outer[own].sum(0), rhs[own].sum(0))
    book.centres = book.centres.astype(np.float32)
    codes = assign(x, book)
    residual = x - np.take_along_axis(book.centres, codes.T[:, :, None], 1).transpose(1, 0, 2).reshape(x.shape)
    asked = x[rng.integers(0, len(x), 256)]
    book.slack = 3 * 2 * float(max((asked @ residual[:2048].T).std(), np.sqrt(((x * residual).sum(1) ** 2).mean())))
    return book


def search_block(book: Codebook, queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int, rerank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, distances) of the k nearest of one block; codes: rows x bytes."""
    half_norm = ((x.astype(np.float64) ** 2).sum(1) / 2).astype(np.float32)
    wide, r = x.astype(np.float64), min(rerank, len(x))
    for lo in range(0, len(queries), 128):
        q = queries[lo : lo + 128]
        small = np.einsum("qjw,jcw->qjc", padded(q).reshape(len(q), -1, WIDTH), book.centres)
        tables = (small[:, 0::2, :, None] + small[:, 1::2, None, :]).reshape(len(q), -1, CODES * CODES).astype(np.float32)
        score = np.tile(-half_norm, (len(q), 1))
        for j in range(codes.shape[1]):
            score += np.take(tables[:, j], codes[:, j], axis=1)
        best = np.argpartition(-score, r - 1, axis=1)[:, :r] if r < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
        for row, near in enumerate(best):
            own, here = query_ids[lo + row], q[row].astype(np.float64)
            near, d = _exact(near, own, here, ids, wide, k)
            # Whatever the tables' error leaves in reach of the k-th distance gets its exact one as well.
            limit = d[k - 1] ** 2 if len(d) >= k else np.inf
            more = np.flatnonzero(score[row] >= (here @ here - limit - book.slack) / 2)
            near, d = _exact(np.union1d(near, more), own, here, ids, wide, k)
            yield own, ids[near], d


def _exact(rows: np.ndarray, own: int, q: np.ndarray, ids: np.ndarray, wide: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of some rows, by distance and id, and their distances."""
    rows = rows[ids[rows] != own]
    d = np.sqrt(((wide[rows] - q) ** 2).sum(1))
    order = np.lexsort((ids[rows], d))[:k]
    return rows[order], d[order]


def usable(table: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, each once."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    kind = "array<double>" if table.schema["embedding"].dataType.simpleString() == "array<double>" else "array<float>"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast(kind).alias("embedding")).where(F.col("vec_id").isNotNull() & fine)
    top = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (top[0]["n"] if top else 0))


def nearest(table: DataFrame, every: int = 100, k: int = 10, rerank: int = 64, block: int = 2048, query_block: int = 4096, sample: int = 10_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by every.

    sample bounds the rows that the codebook is fitted on (drawn by a hash of the id).
    """
    rows = usable(table)
    total = rows.count()
    part = int(min(1.0, sample / max(total, 1)) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < part).orderBy("vec_id").toArrow().to_pandas()
    if drawn.empty:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    book = train(np.stack(drawn.embedding.to_numpy()))
    shared = table.sparkSession.sparkContext.broadcast(book)
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    candidates = rows.dropDuplicates(["vec_id", "embedding"]).withColumn("__at", F.row_number().over(alike)).where(F.col("__at") <= k + 1).drop("__at")
    asking = F.col("vec_id") % every == 0
    queries = rows.where(asking).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks, query_blocks = max(1, math.ceil(total / block)), max(1, math.ceil(rows.where(asking).count() / query_block))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
            c = assign(padded(flat.reshape(b.num_rows, -1)), shared.value) if b.num_rows else np.zeros((0, 2), int)
            packed = (c[:, 0::2] * CODES + c[:, 1::2]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array([r.tobytes() for r in packed], pa.binary())], names=["vec_id", "embedding", "codes"])

    def spread(n: int, own: str) -> list:
        """One block by hash for a row's own side, all n of the other side."""
        return [F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(n)).cast("int").alias(own)]

    coded = candidates.mapInArrow(code, grown(candidates.select("vec_id", "embedding").schema, "codes binary"))
    left = coded.select(*spread(blocks, "b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), "vec_id", "embedding", "codes")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), *spread(query_blocks, "q"), "vec_id", "embedding", F.lit(None).cast("binary").alias("codes"))

    def search(got: pa.Table) -> pa.Table:
        asks = np.array([c is None for c in got.column("codes").to_pylist()])
        ids = got.column("vec_id").to_numpy()
        x = got.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        out = []
        if asks.any() and not asks.all():
            codes = np.frombuffer(b"".join(c for c in got.column("codes").to_pylist() if c is not None), np.uint8).reshape((~asks).sum(), -1)
            out = list(search_block(shared.value, x[asks], ids[asks], x[~asks], ids[~asks], codes, k, rerank))
        cols = [np.repeat([o[0] for o in out], [len(o[1]) for o in out]), np.concatenate([o[1] for o in out] or [[]]), np.concatenate([o[2] for o in out] or [[]])]
        return pa.table([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, np.float64), strict=True)], names=["query_id", "vec_id", "score"])

    found = left.unionByName(right).groupBy("b", "q").applyInArrow(search, NEAREST)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
