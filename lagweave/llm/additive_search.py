"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of codewords, one of each of several codebooks; all codewords have the
full dimension. The codebooks are fitted one after the other to the residuals of a bounded sample,
and the codes are found by a beam search. A row of the index keeps its codes, two norms and its
vector. A query's inner products with all codewords make a lookup table; the sum of a row's entries,
times the row's stored norm ratio, estimates its score. Of each block the rows with the best
estimates, a small share, are scored exactly on the original vectors; nothing else is.

Queries and index are cut into blocks of bounded size. Each pair of blocks is one row of a join by
tile, scored in one task, which returns k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.llm.shared import saved

INDEX_ROWS, QUERY_ROWS, STEP = 4096, 1024, 128
#: Candidates that a task of the last step ranks, about.
RESULT_ROWS = 1 << 18


@dataclass
class Codebooks:
    words: np.ndarray  # books x entries x dimension
    beam: int = 4

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x books) and the vectors they stand for, by beam search over the books."""
        n, (books, entries, d) = len(x), self.words.shape
        codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
        for b in range(books):
            width = rest.shape[1]
            near = (self.words[b] ** 2).sum(1)[None, None, :] - 2 * (rest.reshape(-1, d) @ self.words[b].T).reshape(n, width, entries)
            cost = (near + (rest**2).sum(2)[:, :, None]).reshape(n, -1)
            keep = min(self.beam, cost.shape[1]) if b < books - 1 else 1
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), axis=1, kind="stable"), 1)
            parent, entry = best // entries, best % entries
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), entry[:, :, None].astype(np.uint8)], 2)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - self.words[b][entry]
        return codes[:, 0], x - rest[:, 0]


def fitted(sample: np.ndarray, books: int = 16, entries: int = 256, rounds: int = 6, seed: int = 7) -> Codebooks:
    """Codebooks of a sample: k-means of the residuals that the books before leave."""
    rng, rest, words = np.random.default_rng(seed), sample.astype(np.float32), []
    for _ in range(books):
        centres = rest[rng.permutation(len(rest))[:entries]] if len(rest) >= entries else np.concatenate([rest, np.zeros((entries - len(rest), rest.shape[1]), np.float32)])
        for _ in range(rounds):
            near = ((centres**2).sum(1)[None] - 2 * rest @ centres.T).argmin(1)
            total, count = np.zeros_like(centres), np.bincount(near, minlength=entries)
            order = np.argsort(near, kind="stable")
            used = np.unique(near)
            total[used] = np.add.reduceat(rest[order], np.searchsorted(near[order], used))
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        words.append(centres)
        rest = rest - centres[((centres**2).sum(1)[None] - 2 * rest @ centres.T).argmin(1)]
    return Codebooks(np.stack(words))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of rows that take part."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id is not null and embedding is not null")
    return rows.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0))


def blocks(rows: DataFrame, size: int, models: dict[int, Codebooks] | None, least: int = 1) -> DataFrame:
    """A written table of blocks of vectors of one length: id, d, n, ids (ascending), vectors (float64),
    and with models codes and norms.

    The rows are dealt anew, to `least` tasks or as many as make about one full block each: pairs of
    blocks and files would otherwise grow with the partitions of the input.
    """
    rows = rows.repartition(max(least, ceil(1.1 * rows.count() / size), 1))
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, models = 0, TaskContext.get().partitionId(), shared.value
        for batch in batches:
            length = pc.list_value_length(batch.column(1)).to_numpy()
            for d in np.unique(length).tolist():
                own = batch.filter(pa.array(length == d))
                for at in range(0, own.num_rows, size):
                    ids = own.column(0).slice(at, size).to_numpy()
                    order = np.argsort(ids, kind="stable")
                    ids, x = ids[order], own.column(1).slice(at, size).flatten().to_numpy().reshape(len(ids), d)[order]
                    row = {"id": pa.array([part << 40 | number], pa.int64()), "d": pa.array([d], pa.int32()), "n": pa.array([len(ids)], pa.int64()), "ids": [ids.tobytes()], "vectors": [x.astype("<f8").tobytes()]}
                    if models is not None:
                        codes, near = models[d].encode(x.astype(np.float32))
                        row |= {"codes": [codes.tobytes()], "norms": [norms(x, near).astype("<f8").tobytes()]}
                    yield pa.RecordBatch.from_pydict(row)
                    number += 1

    schema = "id long, d int, n long, ids binary, vectors binary" + ", codes binary, norms binary" * (models is not None)
    return saved(rows.mapInArrow(run, schema), "blocks")


def norms(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The squared norm of what a row's codes stand for, and its inner product with the vector."""
    return np.stack([(near.astype(float) ** 2).sum(1), (x * near).sum(1)], 1)


def estimates(books: Codebooks, q: np.ndarray, codes: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """Estimated inner products of queries (rows) with coded vectors (columns), from lookup tables.

    The stored norms stretch what the codes stand for to the vector's length along it.
    """
    ratio = stored[:, 1] / np.where(stored[:, 0] > 0, stored[:, 0], 1)
    tables = books.words @ q.T.astype(np.float32)  # book, entry, query
    out = tables[0][codes[:, 0]]
    for table, code in zip(tables[1:], codes.T[1:], strict=True):
        out += table[code]
    return np.ascontiguousarray((out * ratio[:, None].astype(np.float32)).T)


def first_of(guess: np.ndarray, depth: int) -> np.ndarray:
    """Places of each row's `depth` largest entries; of equal ones the first."""
    if depth >= guess.shape[1]:
        return np.broadcast_to(np.arange(guess.shape[1]), guess.shape)
    near = np.argpartition(-guess, depth - 1, axis=1)[:, :depth]
    edge = np.take_along_axis(guess, near, 1).min(1)
    above, equal = guess > edge[:, None], guess == edge[:, None]
    for i in np.flatnonzero(above.sum(1) + equal.sum(1) > depth):
        near[i] = np.concatenate([np.flatnonzero(above[i]), np.flatnonzero(equal[i])[: depth - above[i].sum()]])
    return near


def best_pairs(books: Codebooks, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, stored: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of each query's k best rows of a block, and how many were scored exactly.

    ids ascend. Exact scores are of the share of rows with the best estimates, four times k at least;
    a query for which these hold fewer than k different ids has all rows scored.
    """
    single = bool((ids[1:] != ids[:-1]).all())
    different = len(ids) if single else len(np.unique(ids))
    near = first_of(estimates(books, q, codes, stored), min(len(x), max(4 * k, ceil(share * len(x)))))
    score = np.einsum("qrd,qd->qr", x[near], q)
    score[ids[near] == q_ids[:, None]] = -np.inf
    order = np.lexsort((ids[near], -score), axis=1)
    near, score, counted = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1), near.size
    if single:
        near, score = near[:, :k], score[:, :k]
        query, at = np.nonzero(score > -np.inf)
        return query, near[query, at], score[query, at], counted
    out = []
    for i in range(len(q)):
        rows, s = near[i][score[i] > -np.inf], score[i][score[i] > -np.inf]
        first = np.sort(np.unique(ids[rows], return_index=True)[1])[:k]
        if len(first) < min(k, different - int(q_ids[i] in ids)) and len(rows) < len(x):
            rows = np.flatnonzero(ids != q_ids[i])
            s, counted = x[rows] @ q[i], counted + len(rows)
            order = np.lexsort((ids[rows], -s))
            rows, s = rows[order], s[order]
            first = np.sort(np.unique(ids[rows], return_index=True)[1])[:k]
        out.append((np.full(len(first), i), rows[first], s[first]))
    return *(np.concatenate(z) if out else np.zeros(0, int) for z in zip(*out, strict=True)), counted


def models_of(rows: DataFrame, sample_rows: int, books: int, entries: int) -> dict[int, Codebooks]:
    """Codebooks for each length of vectors."""
    out, hashed = {}, rows.select("embedding", F.size("embedding").alias("d"), F.xxhash64("vec_id").alias("h"))
    for d in sorted(r.d for r in hashed.select("d").distinct().collect()):
        sample = hashed.where(F.col("d") == d).orderBy("h").limit(sample_rows).select("embedding").toPandas()
        out[d] = fitted(np.stack(sample["embedding"].to_numpy()), books, entries)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = 0.03, sample_rows: int = 20_000, books: int = 16, entries: int = 256, tiles: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest of all other rows of vectors.

    Nearness is the largest inner product, in double precision over the original vectors; equal
    scores go to the smaller vec_id. Rows with a null vec_id, a null or zero vector, or null or
    non-finite components take no part; a query meets the vectors of its own length. Rows that share
    a vec_id count once, by the best of them, and never for a query of that vec_id. For each length
    the codebooks are fitted to at most sample_rows vectors, those of the smallest hashes of their
    ids; all rows are coded, and all codes scored. share: of each block's rows (4 k at least) are
    scored exactly. No rows give no rows; other columns are ignored.
    """
    rows, asked = usable(vectors), usable(queries)
    models = models_of(rows, sample_rows, books, entries)
    if not models:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.where(F.size("embedding").isin(list(models)))
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    index, wanted = blocks(rows, INDEX_ROWS, models, tasks), blocks(asked, QUERY_ROWS, None)
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    tiles = tiles or max(24, tasks)
    left = wanted.select("d", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"))
    pairs = index.withColumn("tile", F.pmod(F.shiftright("id", 40) + F.col("id").bitwiseAND(F.lit((1 << 40) - 1)), F.lit(tiles))).hint("shuffle_hash").join(left, ["d", "tile"]).select("d", "q_ids", "q", "ids", "vectors", "codes", "norms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for r, d in enumerate(batch.column(0).to_pylist()):
                q_ids, q, ids, x, codes, stored = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in enumerate(("<i8", "<f8", "<i8", "<f8", "u1", "<f8"), 1))
                q, x, codes, stored = q.reshape(-1, d), x.reshape(-1, d), codes.reshape(len(ids), -1), stored.reshape(-1, 2)
                for at in range(0, len(q), STEP):
                    i, row, score, _ = best_pairs(models[d], q_ids[at : at + STEP], q[at : at + STEP], ids, x, codes, stored, k, share)
                    yield pa.RecordBatch.from_pydict({"query_id": q_ids[at : at + STEP][i], "vec_id": ids[row], "score": score.astype(np.float64)})

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    candidates = k * index.count() * (wanted.agg(F.sum("n")).first()[0] or 0)
    return best.coalesce(max(tasks, candidates // RESULT_ROWS))
