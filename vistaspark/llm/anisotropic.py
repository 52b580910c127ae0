"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Vectors are scaled to length one, dealt to lists by their nearest centre, and what is left is
quantised in subspaces of two dimensions with sixteen centres each. Codes and codebooks
minimise a loss in which the error along the vector, the one that changes a high inner
product, weighs more than the error across it. A query scans the four-bit codes of its
nearest lists with a table of partial products, and the best of each block are ranked again
by the exact cosine of the original vectors, with all others whose codes leave it open that
they are nearer: within the lists that are asked nothing is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.llm.common import materialise

WIDTH, CENTRES = 2, 16
#: Inner products above this share of the norms are the ones to keep; it sets the weight of the parallel error.
THRESHOLD = 0.2
#: Rows that the centres and codebooks are fitted on.
SAMPLE_ROWS = 20_000
#: Best of a block by code that are ranked again in any case.
RERANKED = 128
#: Rows and queries of a list that meet in one group.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square is lost or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Cosines of rows and a vector in double precision, whatever their lengths."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    vector = vector / np.abs(vector).max()
    return (rows * vector).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((vector * vector).sum()))


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    score = x @ centres.T - 0.5 * (centres * centres).sum(1)
    if n >= len(centres):
        return np.argsort(-score, axis=1, kind="stable")
    return np.argpartition(-score, n - 1, axis=1)[:, :n]


def fit_centres(x: np.ndarray, n: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)[:, 0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def encode(x: np.ndarray, residual: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes by coordinate descent over the subspaces on |r - c|^2 + (weight - 1) * (x . (r - c))^2."""
    m = books.shape[0]
    xs, rs = x.reshape(len(x), m, WIDTH), residual.reshape(len(x), m, WIDTH)
    across = ((rs[:, :, None, :] - books) ** 2).sum(3)
    along = np.einsum("nmw,mkw->nmk", xs, books)
    codes = across.argmin(2)
    rows = np.arange(len(x))
    error = (x * residual).sum(1) - along[rows[:, None], np.arange(m), codes].sum(1)
    for _ in range(sweeps):
        for j in range(m):
            without = error + along[rows, j, codes[:, j]]
            loss = across[:, j] + (weight - 1) * (without[:, None] - along[:, j]) ** 2
            codes[:, j] = loss.argmin(1)
            error = without - along[rows, j, codes[:, j]]
    return codes


def fit_books(x: np.ndarray, residual: np.ndarray, weight: float, rounds: int = 4, seed: int = 5) -> np.ndarray:
    """Codebooks, alternating codes with the least-squares centres of the same loss."""
    m = x.shape[1] // WIDTH
    xs, rs = x.reshape(len(x), m, WIDTH), residual.reshape(len(x), m, WIDTH)
    books = np.stack([_pad(fit_centres(rs[:, j], CENTRES, 4, seed)) for j in range(m)])
    for _ in range(rounds):
        codes = encode(x, residual, books, weight, 1)
        along = np.einsum("nmw,mkw->nmk", xs, books)[np.arange(len(x))[:, None], np.arange(m), codes]
        error = (x * residual).sum(1) - along.sum(1)
        for j in range(m):
            wanted = error + along[:, j]  # what the subspace should give along x
            for k in range(CENTRES):
                mine = codes[:, j] == k
                if mine.any():
                    xx, left = xs[mine, j], rs[mine, j]
                    a = mine.sum() * np.eye(WIDTH) + (weight - 1) * xx.T @ xx
                    books[j, k] = np.linalg.solve(a, left.sum(0) + (weight - 1) * xx.T @ wanted[mine])
            new = np.einsum("nw,nw->n", xs[:, j], books[j, codes[:, j]])
            error, along[:, j] = error + along[:, j] - new, new
    return books


def probes_for(x: np.ndarray, centres: np.ndarray, own: np.ndarray, k: int, share: float = 0.995, trials: int = 256) -> int:
    """How many lists hold that share of the true neighbours, tried on the sample."""
    ranks = []
    place = np.empty(len(centres), np.int64)
    for i in range(min(trials, len(x))):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1))[:k]
        place[nearest(x[i : i + 1], centres, len(centres))[0]] = np.arange(len(centres))
        ranks += list(place[own[best]])
    return int(np.quantile(ranks, share)) + 1


def _pad(centres: np.ndarray) -> np.ndarray:
    return np.concatenate([centres, np.repeat(centres[:1], CENTRES - len(centres), axis=0)])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equal lists of doubles as rows; odd widths get a zero."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, width)
    return np.pad(x, ((0, 0), (0, -width % WIDTH)))


def _encode(width: int, centres: np.ndarray, books: np.ndarray, weight: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(1), width))
                own = nearest(x, centres)[:, 0]
                codes = encode(x, x - centres[own], books, weight).astype(np.uint8)
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = (codes[:, ::2] << 4) | codes[:, 1::2]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array([r.tobytes() for r in packed], pa.binary())], ["vec_id", "v", "list", "codes"])

    return run


def _probe(width: int, centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = nearest(unit(matrix(batch.column(1), width)), centres, probes).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(lists), pa.list_(pa.int32()))], ["query_id", "q", "lists"])

    return run


def _scan(width: int, centres: np.ndarray, books: np.ndarray, k: int):
    m = books.shape[0]

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and rows.num_rows:
            order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
            ids, v = rows["vec_id"].to_numpy()[order], matrix(rows["v"], width)[order]
            packed = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(ids), -1)[:, :m].T.astype(np.int64)
            q, centre = matrix(queries["q"], width), centres[rows["list"][0].as_py()]
            units, asked = unit(v), unit(q)
            # what the codes say, and how far a vector lies from it: so far off its score by the codes can be
            said = centre + books[np.arange(m)[:, None], codes].transpose(1, 0, 2).reshape(len(ids), -1)
            off = np.linalg.norm(units - said, axis=1)
            for query_id, vector, one, score in zip(queries["query_id"].to_pylist(), q, asked, asked @ said.T, strict=True):
                score[ids == query_id] = -np.inf
                best = np.argpartition(-score, RERANKED)[:RERANKED] if len(ids) > RERANKED else np.arange(len(ids))
                best = best[ids[best] != query_id]
                exact = cosines(v[best], vector)
                if len(ids) > RERANKED:
                    # codes that say too little, as those of a crowd closer than the codebooks tell: all that may still be nearer
                    least = (np.sort(exact)[-k] if len(exact) >= k else -np.inf) - 1e-9
                    maybe = score + off >= least
                    maybe[best] = False
                    maybe = np.flatnonzero(maybe & np.isfinite(score))
                    maybe = maybe[units[maybe] @ one >= least]
                    best, exact = np.concatenate([best, maybe]), np.concatenate([exact, cosines(v[maybe], vector)])
                top = np.lexsort((ids[best], -exact))[:k]
                out[0] += [query_id] * len(top)
                out[1].append(ids[best[top]])
                out[2].append(exact[top])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(np.concatenate(out[1]) if out[1] else [], pa.int64()), pa.array(np.concatenate(out[2]) if out[2] else [], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(df: DataFrame, queries: DataFrame, k: int = 5, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` nearest found by cosine, ties to the smaller id.

    ``df`` and ``queries``: vec_id, embedding; other columns are not read, whatever their
    names. Vectors that are null, zero, or hold nulls, NaN or infinities take no part; a
    cosine is defined for vectors of one width alone, so neither do those of another width
    than most of the sample has. Very small and very large components count like any other.
    Equal vectors tie, repeated rows are one neighbour; a query's own id is never its
    neighbour. With fewer than ``k`` candidates all of them are given. An empty table, or no
    queries, give an empty result. All vectors are indexed; centres and codebooks come from
    at most ``SAMPLE_ROWS`` of them, chosen by a hash of the id.
    """
    spark, empty = df.sparkSession, "query_id long, rank int, vec_id long, score double"

    def valid(x: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        ok = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
        return x.filter(F.col("vec_id").isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))

    rows = valid(df)
    taken = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()]
    if not taken:
        return spark.createDataFrame([], empty)
    sizes = np.bincount([len(v) for v in taken])
    width = int(sizes.argmax())
    x = unit(np.pad(np.array([v for v in taken if len(v) == width]), ((0, 0), (0, -width % WIDTH))))
    rows = rows.filter(F.size("v") == width)
    total = rows.count()
    lists = lists or max(1, min(int(math.sqrt(total)), len(x) // 5 or 1))
    centres = fit_centres(x, lists)
    dims = x.shape[1]
    weight = max(1.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    own = nearest(x, centres)[:, 0]
    probes = min(len(centres), probes or max(8, probes_for(x, centres, own, k)))
    books = fit_books(x, x - centres[own], weight)
    index = materialise(rows.mapInArrow(_encode(width, centres, books, weight), "vec_id long, v array<double>, list int, codes binary"), "ann-index")
    asked = valid(queries).filter(F.size("v") == width)
    probed = asked.mapInArrow(_probe(width, centres, probes), "query_id long, q array<double>, lists array<int>")
    probed = materialise(probed.select("query_id", "q", F.explode("lists").alias("list")), "ann-queries")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def nearest_of(found: DataFrame) -> DataFrame:
        return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = materialise(nearest_of(_searched(index, probed, width, centres, books, k)), "ann-found")
    # queries whose lists hold too few vectors are asked of all lists; few, since a list holds hundreds
    wanted = F.lit(min(k, total - 1))
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= wanted).select("query_id")
    short = probed.select("query_id", "q").dropDuplicates(["query_id"]).join(enough, "query_id", "left_anti")
    short = materialise(short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(centres) - 1)))), "ann-short")
    if short.head(1):
        rest = nearest_of(_searched(index, short, width, centres, books, k))
        found = found.join(short.select("query_id").distinct(), "query_id", "left_anti").union(rest)
    return found


def _searched(index: DataFrame, probed: DataFrame, width: int, centres: np.ndarray, books: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: the best of each block of the lists that the queries (query_id, q, list) ask.

    Vectors travel with their codes, one copy for each block of queries of their list: a
    query reranks so many that fetching them afterwards would move more.
    """
    # blocks of rows and of queries: at most one row a list, known by their counts
    blocks = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("row_blocks"))
    asked = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    sizes = F.broadcast(materialise(blocks.join(asked, "list"), "ann-blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probed.join(sizes, "list").withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int")).withColumn("row_block", every("row_blocks"))
    right = index.join(sizes, "list").withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")).cast("int")).withColumn("query_block", every("query_blocks"))
    key = ["list", "row_block", "query_block"]
    return left.select(*key, "query_id", "q").groupBy(*key).cogroup(right.select(*key, "vec_id", "v", "codes").groupBy(*key)).applyInArrow(_scan(width, centres, books, k), "query_id long, vec_id long, score double")
