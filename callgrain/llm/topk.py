"""Exact top-k search by distributed histogram selection.

Queries go in blocks of bounded size against all rows. Every score is counted in a histogram for its query; the sums over all rows tell the bin
of the k-th value, which the next round divides again, until a bin is one value wide. Then rows that reach the k-th value are filtered, ties
go to smaller ids. Rows are never shuffled, only histograms and the few rows that reach the value.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .base import resting, schema, staged

BINS, QUERIES, SLICE = 256, 8192, 512


def quantised(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray | list[np.ndarray]]:
    """Ids and floor(scale * x) of the vectors that are whole and finite; lengths may differ."""
    column = batch["embedding"]
    if len(batch) and not column.null_count and not batch["vec_id"].null_count:
        values, sizes = column.flatten(), np.diff(column.offsets.to_numpy())
        if not values.null_count and sizes[0] and (sizes == sizes[0]).all():  # the usual case, as one array
            x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1) * scale)
            good = np.isfinite(x).all(axis=1)
            return batch["vec_id"].to_numpy()[good], x[good]
    ids, vectors = [], []
    for i, v in zip(batch["vec_id"].to_pylist(), batch["embedding"], strict=True):
        if i is None or not v.is_valid:
            continue
        values = v.values
        if values.null_count:
            continue
        x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        if np.isfinite(x).all():
            ids.append(i)
            vectors.append(x)
    return np.array(ids, np.int64), vectors


def matrix(vectors: np.ndarray | list[np.ndarray], dims: int) -> np.ndarray:
    """Rows of dims values; shorter vectors are filled with zeros, which leave inner products alone."""
    if isinstance(vectors, np.ndarray) and vectors.shape[1] == dims:
        return vectors
    if all(len(v) == dims for v in vectors):
        return np.array(vectors).reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors, strict=True):
        row[: min(dims, len(v))] = v[:dims]
    return out


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while all partial sums are exact there, else in Python's integers, held to 64 bits."""
    most = q.shape[1] * (np.abs(q).max(initial=0.0)) * (np.abs(c).max(initial=0.0))
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = [[sum(a * b for a, b in zip(x, y, strict=True)) for y in ints(c)] for x in ints(q)]
    return np.array([[max(-(2**63), min(2**63 - 1, v)) for v in row] for row in exact], np.int64).reshape(len(q), len(c))


def ints(x: np.ndarray) -> list[list[int]]:
    return [[int(v) for v in row] for row in x.tolist()]


class Block:
    """Queries with, for each, the lowest value of its current range and the width of its bins."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, scale: int):
        self.ids, self.q, self.scale = ids, q, scale
        self.low, self.width = np.zeros(len(ids), np.int64), np.ones(len(ids), np.int64)


def _parts(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, ids, scores [query, row]) in pieces of bounded size; a row that is the query itself counts as none, see `own`."""
    for batch in batches:
        for first in range(0, len(batch), 2000):
            ids, vectors = quantised(batch.slice(first, 2000), block.scale)
            if len(ids):
                c = matrix(vectors, block.q.shape[1])
                for at in range(0, len(block.ids), SLICE):
                    yield at, ids, scores(block.q[at : at + SLICE], c)


def _histograms(block: Block):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a bin below and one above the range close it
        sums = np.zeros((len(block.ids), BINS + 1), np.int64)
        for at, ids, s in _parts(batches, block):
            n = len(s)
            low, width = block.low[at : at + n, None], block.width[at : at + n, None]
            bins = np.clip((s - low) // width, -1, BINS) + 1
            bins[block.ids[at : at + n, None] == ids[None, :]] = 0
            flat = np.bincount((bins + np.arange(n)[:, None] * (BINS + 2)).ravel(), minlength=n * (BINS + 2)).reshape(n, BINS + 2)
            sums[at : at + n] += flat[:, 1:]
        for at in range(0, len(block.ids), SLICE):
            if sums[at : at + SLICE].any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([at // SLICE], pa.int32()), "counts": pa.array([zlib.compress(sums[at : at + SLICE].tobytes(), 1)], pa.binary())})

    return run


@resting
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(v), np.int64)
            sums[k] = sums[k] + x if k in sums else x
    for k, x in sums.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})


def _reaching(block: Block, k: int):
    """For each query the rows above its k-th value, and of those that equal it the k smallest ids of the partition."""

    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(block.ids)
        for at, ids, s in _parts(batches, block):
            hit = (s >= block.low[at : at + len(s), None]) & (block.ids[at : at + len(s), None] != ids[None, :])
            for j in np.flatnonzero(hit.any(axis=1)):
                row = hit[j]
                v, i = np.concatenate([held[at + j][0], s[j][row]]), np.concatenate([held[at + j][1], ids[row]])
                if len(v) > k:
                    order = np.lexsort((i, -v))[:k]
                    v, i = v[order], i[order]
                held[at + j] = (v, i)
        for at in range(0, len(held), SLICE):
            n = [len(v) for v, _ in held[at : at + SLICE]]
            if sum(n):
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(block.ids[at : at + SLICE], n), "vec_id": np.concatenate([i for _, i in held[at : at + SLICE]]), "score": np.concatenate([v for v, _ in held[at : at + SLICE]])})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """The k highest inner products of each query with the rows of vectors (vec_id long, embedding array), components floor(scale * x):
    query_id, rank from 1, vec_id, score; all, if fewer. Ties go to the smaller vec_id.

    queries are rows like those of vectors. A row is no candidate of a query with its vec_id. Vectors that are null, or hold a null or a
    component that isn't finite, take no part, nor do rows with a null vec_id; vectors of other lengths count as filled with zeros. A
    vec_id that several query rows have is one query, with the least of its vectors; repeated rows of vectors are candidates each. Scores
    beyond 64 bits are held to them. Empty tables give no rows; other columns are ignored.

    The driver holds one block of at most about 8192 queries and their histograms at a time.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    wanted = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    wanted = wanted.where(fit).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    square = "sqrt(aggregate(embedding, 0D, (a, x) -> a + if(x is null or isnan(x) or abs(x) = double('Infinity'), 0D, double(x) * double(x))))"
    shape = vectors.where("embedding is not null").agg(F.max(F.size("embedding")), F.max(F.expr(square))).first()
    dims, norm = shape[0] or 0, shape[1] or 0.0
    blocks = -(-wanted.count() // QUERIES)
    out: DataFrame | None = None
    kind = schema("query_id long, vec_id long, score long")
    for b in range(blocks):
        rows = (wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).collect()
        values = [np.floor(np.array(r["embedding"], np.float64) * scale) for r in rows]
        block = Block(np.array([r["vec_id"] for r in rows], np.int64), matrix(values, dims), scale)
        # |q . c| is at most the product of lengths; floor() moves a component by less than 1
        reach = np.sqrt((block.q**2).sum(axis=1)) * (norm * scale + math.sqrt(dims) + 1)
        reach = np.minimum(np.ceil(reach) + 1, 2.0**61).astype(np.int64)
        block.low, block.width = -reach, (2 * reach) // BINS + 1
        need = np.full(len(rows), k, np.int64)
        while True:
            found = vectors.mapInArrow(_histograms(block), schema("slice int, counts binary")).repartition(max(1, -(-len(rows) // SLICE)), "slice").mapInArrow(_summed, schema("slice int, counts binary")).collect()
            counts = np.zeros((len(rows), BINS + 1), np.int64)
            for r in found:
                x = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64).reshape(-1, BINS + 1)
                counts[r["slice"] * SLICE :][: len(x)] = x
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows in this bin or a higher one
            enough = above >= need[:, None]
            at = np.where(enough.any(axis=1), BINS - np.argmax(enough[:, ::-1], axis=1), 0)
            done = bool((block.width <= 1).all())
            block.low = block.low + at * block.width
            if done:
                break
            block.width = np.maximum(1, -(-block.width // BINS))
        hits = staged(vectors.mapInArrow(_reaching(block, k), kind))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], kind)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
