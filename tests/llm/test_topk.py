"""Exact top-k against all products."""

import math

import numpy as np
import pytest
from oracles import connect, spark_rows, sql_rows

from facetledger.llm import topk
from facetledger.llm.queries import ORACLES, QUERIES


def test_whole_table_against_sql(spark, small):
    assert spark_rows(QUERIES["op6_topk"](spark, small)) == sql_rows(connect(small), ORACLES["op6_topk"])


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4, 64])
def test_odd_vectors(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(240)]
    rows += [(1000, [0.0] * 5), (1001, [1.0, None, 0.0, 0.0, 0.0]), (1002, None), (1003, [float("nan")] * 5), (1004, [float("inf")] + [0.0] * 4), (None, [1.0] * 5)]
    rows += [(1050, [1.0, 2.0]), (1051, [1.0, -2.0]), (1100, []), (1101, []), (1150, [9.0]), (1200, [50.0] * 5), (1201, [50.0] * 5), (1202, [50.0] * 5), (1203, [-50.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    vectors = topk.usable(frame)
    got = topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5, block, 3, 1)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 5)


def test_repeated_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0]), (2, [3.0]), (2, [3.0]), (50, [1.0])], "vec_id long, embedding array<float>")
    vectors = topk.usable(frame)
    got = topk.top_k(vectors.where("vec_id = 50"), vectors, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 768 * 256), (2, 768 * 256)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_blocks_are_pruned_without_loss():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(3000, 16)) * 100 * rng.exponential(size=(3000, 1)))
    queries = np.floor(rng.normal(size=(20, 16)) * 100)
    ids = np.arange(3000)
    products = queries @ vectors.T
    bounds = np.sort(products, 1)[:, -5]
    for known in (np.full(20, -np.inf), bounds):
        found = topk.search_block(queries, known, np.full(20, -1), vectors, ids, 5)
        for row in range(20):
            best = sorted((-products[row, i], i) for i in range(3000))[:5]
            assert sorted((-s, i) for r, i, s in found if r == row) == best
