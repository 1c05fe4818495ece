"""Exact top-k inner products over vectors sorted by length.

Vectors are packed into blocks in the order of their lengths; each block is rotated by the singular vectors of its own
rows, so that the first coordinates carry most of the products. A block meets each block of queries once. The first blocks
give every query a k-th best product to beat; a later block is skipped for the queries that Cauchy-Schwarz says it cannot
improve, and inside a block a vector is completed only if its partial product plus the product of the residual lengths can
reach the query's bound. Products are of whole numbers and exact; bounds have room for rounding.

Queries are a stated set, in blocks of ``query_block``; a task holds one block of vectors and one of queries.

Defined results: vectors that are null or hold a null or a non-finite component take no part; only vectors of the same
number of components are compared; ties go to the smaller id, then to the first of equal rows; every row with the query's
own id is left out; a null id takes no part; a query given several times counts once for each row. Products are exact up to 2 ** 53.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetledger.runtime import stage

BLOCK = 2048
QUERY_BLOCK = 1024
PAIRS_AT_ONCE = 1 << 15


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, the vector as whole numbers floor(scale * x), its squared length, and its number of components."""
    numbers = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where("vec_id is not null").where(F.coalesce(finite, F.lit(False)))
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("v"))
    return whole.withColumns({"length2": F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), "size": F.size("v")})


def pack(rows: DataFrame, block: int, order: list) -> DataFrame:
    """Blocks of at most ``block`` rows of one size in the given order: size, block, ids and values as little-endian
    bytes. Rows are numbered in range partitions, so that no task sees more than its part of the table."""
    ranged = rows.repartitionByRange(F.col("size"), *order).sortWithinPartitions(F.col("size"), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        ids, values, size = [], [], None

        def flush() -> pa.RecordBatch:
            nonlocal count, ids, values
            count += 1
            names = ["size", "block", "ids", "values"]
            out = [[size], [(part << 32) + count], [np.array(ids, "<i8").tobytes()], [np.concatenate(values or [np.zeros(0)]).astype("<f8").tobytes()]]
            ids, values = [], []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

        for batch in batches:
            vectors = batch.column("v")
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for k, (vec_id, n) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                if ids and (n != size or len(ids) >= block):
                    yield flush()
                size = n
                ids.append(vec_id)
                values.append(flat[offsets[k] : offsets[k + 1]].copy())
        if ids:
            yield flush()

    return ranged.select("vec_id", "v", "size").mapInArrow(run, "size int, block long, ids binary, values binary")


def search_block(queries: np.ndarray, bounds: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query row, vector id, product) of the best k vectors of a block for each query that may enter its top k.

    ``bounds``: the k-th best product known for each query, -inf if none is.
    """
    n, size = vectors.shape
    lengths = np.sqrt((vectors * vectors).sum(1))
    query_lengths = np.sqrt((queries * queries).sum(1))
    slack = 1e-9 * (lengths.max(initial=0) * query_lengths + 1)
    alive = np.flatnonzero(query_lengths * lengths.max(initial=0) + slack >= bounds)
    if not len(alive) or not n:
        return []
    order = np.lexsort((ids, -lengths))
    vectors, ids, lengths = vectors[order], ids[order], lengths[order]
    _, turn = np.linalg.eigh(vectors.T @ vectors) if size else (None, np.zeros((0, 0)))
    turn = turn[:, ::-1]
    head = max(1, size // 4)
    q, x = queries[alive] @ turn, vectors @ turn
    q_rest, x_rest = np.sqrt((q[:, head:] ** 2).sum(1)), np.sqrt((x[:, head:] ** 2).sum(1))
    best = bounds[alive].copy()
    kept: list[list[tuple[float, int]]] = [[] for _ in alive]
    step = max(64, 4 * k)
    begin = 0
    while begin < n:
        rows = slice(begin, begin + step)
        open_ = np.flatnonzero(query_lengths[alive] * lengths[begin] + slack[alive] >= best)
        if not len(open_):
            break  # the lengths only fall from here
        partial = q[open_, :head] @ x[rows, :head].T
        upper = partial + q_rest[open_, None] * x_rest[rows][None, :] + slack[alive[open_], None]
        at, column = np.nonzero((upper >= best[open_, None]) & (ids[rows][None, :] != own[alive[open_], None]))
        if len(at):
            exact = np.empty(len(at))
            for cut in range(0, len(at), PAIRS_AT_ONCE):
                some = slice(cut, cut + PAIRS_AT_ONCE)
                exact[some] = np.einsum("ij,ij->i", queries[alive[open_[at[some]]]], vectors[rows][column[some]])
            cuts = np.searchsorted(at, np.arange(len(open_) + 1))
            for j in np.flatnonzero(np.diff(cuts)):
                mine = slice(cuts[j], cuts[j + 1])
                row = open_[j]
                some = kept[row] + list(zip((-exact[mine]).tolist(), ids[rows][column[mine]].tolist(), strict=True))
                some.sort()
                kept[row] = some[:k]
                if len(some) >= k:
                    best[row] = max(best[row], -some[k - 1][0])
        begin, step = begin + step, min(step * 2, 1024)
    return [(int(alive[row]), vec, -score) for row, some in enumerate(kept) for score, vec in some]


def _searcher(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own, ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                queries = np.frombuffer(r["q_values"], "<f8").reshape(len(own), r["size"])
                vectors = np.frombuffer(r["values"], "<f8").reshape(len(ids), r["size"])
                bounds = np.frombuffer(r["bounds"], "<f8") if r["bounds"] is not None else np.full(len(own), -np.inf)
                found = search_block(queries, bounds, own, vectors, ids, k)
                columns = [[r["q_block"]] * len(found), [x[0] for x in found], own[[x[0] for x in found]] if found else [], [x[1] for x in found], [int(x[2]) for x in found]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["q_block", "q_row", "query_id", "vec_id", "score"],
                )

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK, head_blocks: int = 2) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best products of each query. Both tables come from ``usable``."""
    found = "q_block long, q_row int, query_id long, vec_id long, score long"
    x = stage(pack(vectors, block, [F.col("length2").desc(), F.col("vec_id")]))
    q = stage(pack(queries, query_block, [F.col("vec_id")]).withColumnsRenamed({"block": "q_block", "ids": "q_ids", "values": "q_values"}))
    # Which block meets which is a small table of numbers: a stated set of queries against all rows, in blocks.
    meets = q.select("size", "q_block").join(x.select("size", "block"), "size").withColumn("_at", F.row_number().over(Window.partitionBy("size", "q_block").orderBy("block")))
    meets = stage(meets)
    best = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")

    def search(pairs: DataFrame, bounds: DataFrame | None) -> DataFrame:
        both = pairs.join(q, ["size", "q_block"])
        both = both.join(bounds, "q_block", "left") if bounds is not None else both.withColumn("bounds", F.lit(None).cast("binary"))
        both = both.join(x, ["size", "block"]).select("size", "q_block", "q_ids", "q_values", "bounds", "ids", "values")
        hits = both.mapInArrow(_searcher(k), found)
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = stage(search(meets.where(F.col("_at") <= head_blocks), None))
    kth = first.where(F.col("rank") == k).groupBy("q_block").agg(F.collect_list(F.struct("q_row", "score")).alias("known"))  # at most a block of queries
    sizes = q.select("q_block", (F.octet_length("q_ids") / 8).cast("int").alias("n"))
    bounds = stage(sizes.join(kth, "q_block", "left").mapInArrow(_bounds, "q_block long, bounds binary"))
    rest = search(meets.where(F.col("_at") > head_blocks), bounds)
    both = first.drop("rank").unionByName(rest.drop("rank")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            bound = np.full(r["n"], -np.inf)
            for x in r["known"] or []:
                bound[x["q_row"]] = x["score"]
            out.append(bound.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("q_block"), pa.array(out, pa.binary())], names=["q_block", "bounds"])
