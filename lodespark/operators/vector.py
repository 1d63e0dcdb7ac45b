"""Exact nearest neighbours by cosine distance, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096  #: queries that are held by every task at once
ROWS = 1024  #: vectors that are compared with them at once


def cosine_score(distance: Column) -> Column:
    """A distance from 0 to 2 as a score from 1 to 0."""
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalised(v: Column, dims: int | None = None) -> Column:
    """Unit length, after cutting to the first ``dims``; a zero vector stays zero."""
    w = F.slice(v, 1, dims) if dims else v
    return F.transform(w, lambda x: x.cast("double") / F.greatest(norm(w), F.lit(1e-12)))


def valid(v: Column, dims: int) -> Column:
    """The right number of dimensions, all finite."""
    return (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _local_top(ids: np.ndarray, unit: np.ndarray, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d = np.full((len(ids), k), np.inf)
        best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            own_ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            for s in range(0, batch.num_rows, ROWS):
                own = own_ids[s : s + ROWS]
                width = len(flat) // batch.num_rows
                x = flat[s * width : (s + len(own)) * width].astype(np.float64).reshape(len(own), width)
                n = np.sqrt((x * x).sum(1))
                d = 1 - unit @ (x / np.where(n > 0, n, 1)[:, None]).T
                d[:, n == 0] = 1.0
                # Only what may be among the best so far, or the best of this block, is sorted in; equal ones stay in.
                most = best_d[:, -1] if len(own) <= k else np.minimum(best_d[:, -1], np.partition(d, k - 1, axis=1)[:, k - 1])
                q, j = np.nonzero(d <= most[:, None] + 1e-11)
                touched, counts = np.unique(q, return_counts=True)
                all_q = np.concatenate([np.repeat(touched, k), q])
                all_d, all_i = np.concatenate([best_d[touched].ravel(), d[q, j]]), np.concatenate([best_i[touched].ravel(), own[j]])
                order = np.lexsort((all_i, np.round(all_d, 12), all_q))
                first = np.concatenate([[0], np.cumsum(counts + k)[:-1]])
                take = order[first[:, None] + np.arange(k)[None, :]] if len(touched) else np.zeros((0, k), np.int64)
                best_d[touched], best_i[touched] = all_d[take], all_i[take]
        q, j = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_i[q, j]), pa.array(best_d[q, j])], schema=schema)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, dims: int = 64, block: int = BLOCK) -> DataFrame:
    """``query_id, vec_id, distance``: the ``k`` nearest of all vectors for each query, ties by id.

    ``vectors``: ``vec_id, embedding``; ``queries``: ``query_id, embedding``. Each task keeps its own top ``k``, so that no more than that is
    shuffled. Queries come in blocks, one pass over the vectors each. Vectors of other dimensions, or with values that are
    not finite, are left out. Distances of zero vectors are 1.
    """
    rows = vectors.filter(F.col("embedding").isNotNull() & valid(F.col("embedding"), dims)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    wanted = queries.filter(F.col("embedding").isNotNull() & valid(F.col("embedding"), dims)).select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    found, part = None, []

    def flush(part: list) -> DataFrame:
        ids = np.array([r["query_id"] for r in part], np.int64)
        x = np.array([r["embedding"] for r in part], np.float64).reshape(len(part), dims)
        n = np.sqrt((x * x).sum(1))
        return rows.mapInArrow(_local_top(ids, x / np.where(n > 0, n, 1)[:, None], k), "query_id long, vec_id long, distance double")

    for r in wanted.toLocalIterator():
        part.append(r)
        if len(part) == block:
            found = flush(part) if found is None else found.unionByName(flush(part))
            part = []
    if part or found is None:
        found = flush(part) if found is None else found.unionByName(flush(part))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "vec_id", "distance")


def nearest_by(hits: DataFrame, by: str) -> DataFrame:
    """Several chunks of one document count once, with the least distance."""
    return hits.groupBy("query_id", by).agg(F.min("distance").alias("distance"))


def _cells(centres: np.ndarray, probes: int, key: str):
    schema = pa.schema([(key, pa.int64()), ("unit", pa.list_(pa.float32())), ("cell", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            n = np.sqrt((flat * flat).sum(1, keepdims=True))
            x = flat / np.where(n > 0, n, 1)
            cells = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            units = pa.array(list(np.repeat(x.astype(np.float32), cells.shape[1], axis=0)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, cells.shape[1])), units, pa.array(cells.ravel().astype(np.int32))], schema=schema)

    return run


def cell_centres(vectors: DataFrame, n_cells: int, dims: int, fit_rows: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Centres of ``n_cells`` cells by spherical k-means, fitted on at most ``fit_rows`` vectors, those of least hash of the id."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id")).limit(fit_rows).collect()
    x = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), dims)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    x = (x / np.where(n > 0, n, 1))[n[:, 0] > 0]
    centres = x[: max(1, min(n_cells, len(x)))].copy() if len(x) else np.zeros((1, dims))
    for _ in range(rounds if len(x) else 0):
        cell = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def near_by_cells(vectors: DataFrame, queries: DataFrame, k: int = 10, dims: int = 64, n_cells: int = 64, probes: int = 44, per_block: int = 2_000, fit_rows: int = 20_000) -> DataFrame:
    """``query_id, vec_id, distance``: the ``k`` nearest vectors in the ``probes`` cells that are nearest to each query; approximate.

    The defaults suit vectors that form no clusters, where nine of ten neighbours lie in no fewer than two thirds of the cells; where there are
    clusters, far fewer ``probes`` will do.
    For more queries than ``nearest`` can take, which compares every vector with every query: here both sides stay distributed, and meet by cell. Every
    vector is in the index, in one cell; only the centres are fitted on a sample (``fit_rows``). A cell of more than ``per_block``
    vectors is cut into blocks, to each of which its queries are sent, so a hot cell passes through no single task. A query's hits are cut to
    the best ``k`` within each block before they are shuffled. Invalid and zero vectors are left out.
    """
    fine = lambda df: df.filter(F.col("embedding").isNotNull() & valid(F.col("embedding"), dims) & (norm(F.col("embedding")) > 0))
    rows, wanted = fine(vectors), fine(queries)
    centres = cell_centres(rows, n_cells, dims, fit_rows)
    index = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_cells(centres, 1, "vec_id"), "vec_id long, unit array<float>, cell int")
    asked = wanted.select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInArrow(_cells(centres, probes, "query_id"), "query_id long, unit array<float>, cell int")
    blocks = F.broadcast(index.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / per_block), F.lit(1)).cast("int").alias("blocks")))  # one row a cell
    placed = index.join(blocks, "cell").select("vec_id", "unit", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"))
    sent = asked.join(blocks, "cell").select("query_id", "unit", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])

    def best(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return schema.empty_table()
        x = own.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1).astype(np.float64)
        ids, parts = own.column("vec_id").to_numpy(), []
        all_q = asked.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(asked.num_rows, -1).astype(np.float64)
        names = asked.column("query_id").to_numpy()
        for s in range(0, len(names), ROWS):
            d = 1 - all_q[s : s + ROWS] @ x.T
            some = np.argsort(np.round(d, 7), axis=1, kind="stable")[:, :k]
            parts.append((np.repeat(names[s : s + ROWS], some.shape[1]), ids[some].ravel(), np.take_along_axis(d, some, 1).ravel()))
        return pa.table([np.concatenate(c) for c in zip(*parts)], schema=schema)

    hits = placed.groupBy("cell", "block").cogroup(sent.groupBy("cell", "block")).applyInArrow(best, "query_id long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 7), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "vec_id", "distance")
