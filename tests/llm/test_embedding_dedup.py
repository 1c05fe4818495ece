"""Near-duplicate vectors against all pairs in double precision."""

import math

import numpy as np
import pytest
from oracles import connect, spark_rows, sql_rows

from facetledger.llm import embedding_dedup as op
from facetledger.llm.queries import ORACLES, QUERIES


def brute(rows, threshold=0.9):
    """Of (id, vector): sorted (id, links, component, kept)."""
    good = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = {d for d, _ in rows if d is not None}
    root = {d: d for d in ids}
    rows = [(d, [math.ldexp(x, -math.frexp(max(map(abs, v)))[1]) for x in v]) if i in good else (d, v) for i, (d, v) in enumerate(rows)]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a, i in enumerate(good):
        for j in good[a + 1 :]:
            (d, v), (e, w) = rows[i], rows[j]
            if len(v) == len(w) and math.fsum(x * y for x, y in zip(v, w, strict=True)) / math.sqrt(math.fsum(x * x for x in v) * math.fsum(x * x for x in w)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return sorted(((d, n, None if d is None else find(d), d is None or find(d) == d) for (d, _), n in zip(rows, links, strict=True)), key=repr)


def got(frame, threshold=op.THRESHOLD):
    return sorted(map(tuple, op.near_duplicates(frame, threshold).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def test_whole_table_against_sql(spark, small):
    assert spark_rows(QUERIES["op12_embedding_dedup"](spark, small)) == sql_rows(connect(small), ORACLES["op12_embedding_dedup"])


def vectors(seed=4, groups=6, copies=14, dim=12):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        out += [(100 * g + k, (centre + rng.normal(size=dim) * 0.3).tolist()) for k in range(copies)]  # on both sides of 0.9
    return out + [(5000 + i, rng.normal(size=dim).tolist()) for i in range(60)]


@pytest.mark.parametrize("rows", [op.LEAST_ROWS, 16])
def test_odd_vectors(spark, monkeypatch, rows):
    monkeypatch.setattr(op, "LEAST_ROWS", rows)  # few blocks, or twelve
    data = vectors()
    data += [(9000, None), (9001, []), (9002, [0.0] * 12), (9003, [1.0, None] + [0.0] * 10), (9004, [float("nan")] * 12), (9005, [float("inf")] + [0.0] * 11), (None, data[0][1]), (9006, [-0.0] * 12)]
    data += [(9010, [1.0, 0.0, 0.0, 0.0]), (9011, [9.0, 3.0, 3.0, 1.0]), (9012, [9.0, 3.0, 3.0, 1.001]), (9013, [2e300, 0.0, 0.0, -0.0]), (9014, [5e-320, 0.0, 0.0, 0.0]), (9015, [3.0])]
    data += [data[3], data[3], (7, data[20][1]), (7, data[20][1])]  # repeated rows, and an id with two vectors
    frame = spark.createDataFrame([(d, v, "clash", 1) for d, v in data], "vec_id long, embedding array<double>, mark string, id int").repartition(5)
    want = brute(data)
    assert got(frame) == want
    links = {d: n for d, n, _, _ in want}
    assert links[9011] == 4 and links[9012] == 1 and links[9015] == 0  # exactly 0.9 links
    assert got(frame.limit(0)) == []


def test_floats_and_one_large_group(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=64)
    data = [(i, np.float32(base + rng.normal(size=64) * 0.05).tolist()) for i in range(300)] + [(1000 + i, np.float32(base).tolist()) for i in range(200)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = got(frame)
    assert found == sorted(((i, 499, 0, i == 0) for i, _ in data), key=repr)


def test_long_vectors_are_added_exactly():
    rng = np.random.default_rng(1)
    q = rng.choice([-127, 127], (3, 5000)).astype(np.int8)
    assert (op.products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(2)
    for dim in (2, 7, 64, 1500):
        base = rng.normal(size=dim) * rng.exponential(size=dim) ** 3
        x = op.scaled(base + rng.normal(size=(200, dim)) * np.abs(base).mean() * rng.uniform(0, 0.6, (200, 1)))
        q, step, error = op.quantise(x)
        side = op.Side({"ids": np.arange(200).tobytes(), "ns": np.ones(200, np.int64).tobytes(), "q": q.tobytes(), "step": step.tobytes(), "error": error.tobytes(), "x": x.tobytes()})
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        for threshold in (0.05, 0.9, 0.999):
            maybe = np.zeros((200, 200), bool)
            maybe[tuple(op.possible(side, slice(0, 200), side, threshold))] = True
            assert maybe[unit @ unit.T >= threshold].all()
            i, j = op.linked_pairs(side, slice(0, 200), side, threshold, True)
            assert len(i) == (np.triu(unit @ unit.T, 1) >= threshold).sum()


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError):
        op.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), 0.0)
