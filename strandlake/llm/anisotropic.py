"""Nearest neighbours by score-aware anisotropic quantisation.

Directions are quantised in subspaces of two coordinates with 16 centres each (four
bits).  Codebooks minimise the anisotropic loss

    parallel * |r_par|^2 + |r_perp|^2,   parallel = (d - 1) T^2 / (1 - T^2),

where r_par is the part of the residual along the vector: an error there shifts large
inner products, so it costs more.  Codes are chosen by coordinate descent over the
subspaces and the centres by the exact least-squares solution for all subspaces at
once, in turn, on a bounded sample of ``fit_rows`` rows.  Every row is then coded.

Rows stay where they are: queries come to them in blocks of bounded size, one broadcast
after the other, and each task holds its rows against them in slabs.  There each query's
tables (two subspaces at a time, 256 entries) are summed along the codes, and the
``rerank`` best rows by that estimate are measured exactly in double precision.  An
estimate errs by the length of the row's residual at most, so every other row that could
still reach the k-th exact cosine is measured too: the result is that of an exact search.
Only the nearest of each slab are shuffled, and merged by query.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, least_hashed, shared_dir

CENTRES = 16


class Codebook:
    """centres: (subspaces, 16, 2); dimensions are padded to an even number."""

    def __init__(self, sample: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 3):
        x = self.padded(sample)
        n, d = x.shape
        self.parallel = max(1.0, (sample.shape[1] - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        sub = x.reshape(n, d // 2, 2)
        self.centres = np.empty((d // 2, CENTRES, 2))
        for m in range(d // 2):
            c = sub[rng.choice(n, CENTRES, replace=n < CENTRES), m].copy()
            for _ in range(8):
                near = ((sub[:, m, None] - c) ** 2).sum(axis=2).argmin(axis=1)
                for k in range(CENTRES):
                    if (near == k).any():
                        c[k] = sub[near == k, m].mean(axis=0)
            self.centres[m] = c
        for _ in range(rounds):
            self.solve(x, self.codes(x))

    @staticmethod
    def padded(vectors: np.ndarray) -> np.ndarray:
        x = vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]
        return np.pad(x, ((0, 0), (0, x.shape[1] % 4 and 4 - x.shape[1] % 4)))

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of unit vectors: from the nearest centres, subspace by subspace to the
        centre of least anisotropic loss given the others."""
        n, m = len(x), len(self.centres)
        sub = x.reshape(n, m, 2)
        out = np.stack([((sub[:, k, None] - self.centres[k]) ** 2).sum(axis=2).argmin(axis=1) for k in range(m)], axis=1)
        along = sum(((sub[:, k] - self.centres[k][out[:, k]]) * sub[:, k]).sum(axis=1) for k in range(m))
        for _ in range(sweeps):
            for k in range(m):
                r = sub[:, k, None] - self.centres[k]
                each = (r * sub[:, k, None]).sum(axis=2)
                rest = along - each[np.arange(n), out[:, k]]
                loss = (r**2).sum(axis=2) + (self.parallel - 1) * (rest[:, None] + each) ** 2
                out[:, k] = loss.argmin(axis=1)
                along = rest + each[np.arange(n), out[:, k]]
        return out.astype(np.uint8)

    def solve(self, x: np.ndarray, codes: np.ndarray) -> None:
        n, m = codes.shape
        size = m * CENTRES * 2
        sub = x.reshape(n, m, 2)
        z = np.zeros((n, size), np.float32)
        cell = (np.arange(m) * CENTRES + codes) * 2
        rows = np.arange(n)[:, None]
        z[rows, cell], z[rows, cell + 1] = sub[:, :, 0], sub[:, :, 1]
        count = np.repeat(np.bincount((np.arange(m) * CENTRES + codes).ravel(), minlength=m * CENTRES), 2)
        a = (self.parallel - 1) * (z.T @ z).astype(float)
        a[np.diag_indices(size)] += count + 1e-3
        b = self.parallel * z.sum(axis=0, dtype=float) + 1e-3 * self.centres.ravel()
        self.centres = np.linalg.solve(a, b).reshape(m, CENTRES, 2)

    def pairs(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of two subspaces in a byte: (subspaces / 2, rows)."""
        c = self.codes(self.padded(vectors))
        return np.ascontiguousarray((c[:, ::2] * CENTRES + c[:, 1::2]).T)

    def residuals(self, vectors: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Lengths of what the codes leave of the unit vectors."""
        c = np.stack((pairs // CENTRES, pairs % CENTRES), axis=1).reshape(-1, len(vectors)).T
        coded = self.centres[np.arange(c.shape[1]), c].reshape(len(vectors), -1)
        return np.sqrt(((self.padded(vectors) - coded) ** 2).sum(axis=1))

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Inner products with all pairs of centres: (subspaces / 2, 256)."""
        q = self.padded(query[None])[0].reshape(-1, 1, 2)
        one = (self.centres * q).sum(axis=2)
        return (one[::2, :, None] + one[1::2, None, :]).reshape(len(one) // 2, -1).astype(np.float32)


def scan(book: Codebook, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, query_id: int, query: np.ndarray, k: int, rerank: int, errors: np.ndarray | None = None) -> list[tuple[int, float]]:
    """The query's ``k`` nearest rows of a block; rows are in the order of their ids.
    ``errors``: the lengths of the rows' residuals, if known."""
    errors = book.residuals(vectors, codes) if errors is None else errors
    table = book.tables(query)
    score = np.zeros(len(ids), np.float32)
    for m in range(len(table)):
        score += table[m][codes[m]]
    score[ids == query_id] = -np.inf
    live = int((score > -np.inf).sum())
    take = min(max(rerank, k), live)
    if not take:
        return []
    length = np.sqrt((query * query).sum())

    def exact(rows: np.ndarray) -> np.ndarray:
        v = vectors[rows]
        return (v * query).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * length)

    best = np.argpartition(score, len(score) - take)[len(score) - take :]
    cosine = exact(best)
    if take < live:
        reach = np.partition(cosine, take - k)[take - k] - 1e-4  # the k-th; sums of estimates are single precision
        open_ = score + errors >= reach
        open_[best] = False
        more = np.flatnonzero(open_ & (score > -np.inf))
        best, cosine = np.concatenate((best, more)), np.concatenate((cosine, exact(more)))
    order = np.lexsort((ids[best], -cosine))[:k]
    return [(int(ids[best[i]]), float(cosine[i])) for i in order]


def nearest_neighbours(
    df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, rerank: int = 200, fit_rows: int = 8000, row_block: int = 20_000, query_block: int = 20_000
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (cosine): the ``k`` nearest rows
    of each row for which ``queries`` holds, among all rows of another id.

    Rows without an id and vectors that are null, zero, of a length other than the
    commonest, or hold null or non-finite components take no part.  Of rows with the
    same id each is a candidate, but only the least vector is a query.  Equal cosines
    go to the smaller id.  An empty table gives no rows.  Other columns are not read.  ``fit_rows`` bounds the
    sample for the codebooks; the index and the search leave out nothing.  ``rerank``
    is where measuring starts, not where it ends."""
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.transform(v, lambda x: x.cast("double")).alias("_v"), queries.alias("_q")).filter(
        F.col("_id").isNotNull() & F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    )
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return empty
    d, n = sizes[0]["d"], sizes[0]["n"]
    rows = rows.filter(F.size("_v") == d)
    few = least_hashed(rows.select("_id", "_v"), F.xxhash64(F.lit(7), "_id", "_v"), max(CENTRES, min(fit_rows, 4_000_000 // d))).collect()
    few = sorted(few, key=lambda r: (r["_u"], r["_id"]))
    book = df.sparkSession.sparkContext.broadcast(Codebook(np.array([r["_v"] for r in few])))  # 16 * d numbers

    asked = rows.filter("_q").groupBy("_id").agg(F.min("_v").alias("_v"))
    query_blocks = max(1, math.ceil(asked.count() / query_block))
    asked = asked.withColumn("_qb", F.pmod(F.xxhash64(F.lit(2), "_id"), F.lit(query_blocks)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                codes = book.value.pairs(x)
                errors = book.value.residuals(x, codes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes.T], pa.binary()), pa.array(errors)], ["_id", "_v", "_c", "_e"])

    index = rows.select("_id", "_v").mapInArrow(coded, "_id long, _v array<double>, _c binary, _e double")
    if query_blocks > 1:
        asked, index = cut(asked, "queries"), cut(index, "coded")

    def nearest(block: int) -> DataFrame:
        held = sorted((r["_id"], r["_v"]) for r in asked.filter(F.col("_qb") == block).select("_id", "_v").collect())  # about query_block rows
        queries = df.sparkSession.sparkContext.broadcast((np.array([q for q, _ in held]), np.array([v for _, v in held]).reshape(-1, d)))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slab: list[pa.RecordBatch] = []

            def settle() -> pa.RecordBatch:
                rows = pa.Table.from_batches(slab).sort_by("_id").combine_chunks()
                ids = rows.column("_id").to_numpy()
                vectors = rows.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                codes = np.ascontiguousarray(np.frombuffer(b"".join(rows.column("_c").to_pylist()), np.uint8).reshape(len(ids), -1).T)
                errors = rows.column("_e").to_numpy()
                out = [(q, i, s) for q, x in zip(*queries.value) for i, s in scan(book.value, ids, vectors, codes, q, x, k, rerank, errors)]
                cols = list(zip(*out)) or [()] * 3
                return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

            for batch in batches:
                slab.append(batch)
                if sum(b.num_rows for b in slab) >= row_block:
                    yield settle()
                    slab = []
            if sum(b.num_rows for b in slab):
                yield settle()

        near = index.mapInArrow(meet, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if query_blocks == 1:
        return nearest(0)
    path = f"{shared_dir(df.sparkSession)}/nearest-{uuid.uuid4().hex}"
    for block in range(query_blocks):
        nearest(block).write.mode("append").parquet(path)
    return df.sparkSession.read.schema(empty.schema).parquet(path)
