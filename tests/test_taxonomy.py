"""Large taxonomies: the grid and the joins give what one table in every task gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetledger.operators import taxonomy as tx
from facetledger.vocab import LABEL_SUFFIXES


def tree(spark, count, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        parent = None if i < 5 else f"n{int(rng.integers(0, i)) if i < 200 else int(rng.integers(0, 200)):06}"
        vector = rng.normal(size=dim)
        rows.append((f"n{i:06}", parent, f"label-{i}", "", i, (vector / np.linalg.norm(vector)).tolist()))
    return spark.createDataFrame(rows, f"{tx.NODES}, vector array<double>")


def queries(spark, count=30, dim=6):
    rng = np.random.default_rng(2)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(count, dim)))]
    odd = [(count + 1, None), (count + 2, [1.0] + [None] * (dim - 1)), (count + 3, [1.0]), (count + 4, []), (count + 5, [float("nan")] * dim)]
    return spark.createDataFrame([*rows, (count, rows[0][1]), *odd], "q int, embedding array<double>")


@pytest.mark.parametrize("count, rows", [(400, 60), (21_000, 20_000)])
def test_the_grid_equals_one_table(spark, monkeypatch, count, rows):
    nodes, asked = tree(spark, count), queries(spark)
    told = lambda f, c, k: {r["q"]: [(h["id"], h[k]) for h in r[c]] for r in f.collect()}  # to the last bit
    hits = told(tx.top_k(asked, nodes, 7), "hits", "similarity")
    subtree = told(tx.with_subtree(asked, nodes, 7), "subtree", "score")
    monkeypatch.setattr(tx, "TABLE_BYTES", 0)
    monkeypatch.setattr(tx, "GRID_ROWS", rows)
    assert told(tx.top_k(asked, nodes, 7), "hits", "similarity") == hits
    assert told(tx.with_subtree(asked, nodes, 7), "subtree", "score") == subtree
    assert all(hits[q] == [] and subtree[q] == [] for q in range(31, 36)) and len(hits[0]) == 7
    assert {r.q: len(r.paths) for r in tx.tree_paths(asked, nodes, 7).collect()}[31] == 0


def test_labels_are_matched_like_by_hand(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("ab-cé"), int(rng.integers(0, 6))))
    labels = sorted({word() for _ in range(60)} | {"x" * 30_0})
    paths = sorted({"/".join(word() + (LABEL_SUFFIXES[0] if rng.integers(4) == 0 else "") for _ in range(int(rng.integers(1, 4)))) for _ in range(150)})
    nodes = spark.createDataFrame([(f"root/{i}" if i % 9 else paths[i], None, name, "", i) for i, name in enumerate(labels)], tx.NODES)
    ids = {f"root/{i}" if i % 9 else paths[i] for i in range(len(labels))}

    def by_hand(path):
        if path in ids:
            return path
        parts = [next((p[: -len(s)] for s in LABEL_SUFFIXES if p.endswith(s)), p) for p in path.split("/")][::-1]
        equal = [p for p in parts if p in labels]
        near = [name for p in parts for name in labels if p in name or name in p]
        return (equal or near or [None])[0]

    frame = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, n int")
    got = {r["path"]: r["match"] for r in tx.match_labels(frame, nodes).collect()}
    assert got == {p: by_hand(p) for p in paths}
    assert tx.match_labels(frame, nodes).columns == ["path", "n", "match"]


def test_thinking_is_cut_and_queries_join_user_messages(spark):
    row = spark.createDataFrame([("<think>a</think> b",)], "t string").select(tx.strip_thinking(F.col("t"))).first()
    assert row[0] == "b"
    calls = spark.createDataFrame([([("user", "one"), ("assistant", "x"), ("user", ""), ("user", "two")],)], "messages array<struct<role:string,content:string>>")
    assert calls.select(tx.query_text()).first()[0] == "one\ntwo"
