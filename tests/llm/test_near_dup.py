"""Near-duplicate components against all pairs of shingle sets."""

import re

import numpy as np
import pytest
from pyspark.sql import Row

from facetledger.llm import groups
from facetledger.llm import near_dup as op
from facetledger.llm.components import components
from facetledger.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute(docs, size=3, percent=85):
    """doc -> (shingles, smallest document that can be reached); one row a document."""
    sets = {d: shingle_set(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(d for d in sets if sets[d])
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def as_rows(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def test_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {d: (n, c, c == d) for d, (n, c) in brute(docs).items()}
    assert as_rows(QUERIES["op2_near_dup"](spark, small)) == want
    assert any(d != c for d, (_, c, _) in want.items())


def near_texts(seed=2, copies=60, size=120):
    """Copies of two texts, each with some words changed, so that similarities lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(2):
        base = rng.choice(words, size).tolist()
        for _ in range(copies // 2):
            text = list(base)
            for _ in range(rng.integers(0, 6)):
                text[rng.integers(len(text))] = words[rng.integers(500)]
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("bands", [op.NEAR, op.Bands(size=5, percent=80)])
def test_near_copies(spark, bands):
    docs = list(enumerate(near_texts()))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "one two three"), (207, "été  Été\tx"), (208, "x " * 60_000), (209, "x x x x x x"), (-1, "three two one")]
    frame = spark.createDataFrame([Row(doc_id=d, text=t, n_shingles="clash", id=3) for d, t in docs], "doc_id long, text string, n_shingles string, id int").repartition(4)
    want = {d: (n, c, c == d) for d, (n, c) in brute(docs, bands.size, bands.percent).items()}
    assert as_rows(op.find_components(frame, bands)) == want
    kept = op.keep_one(frame, bands)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, x in want.items() if x[2])


def test_long_near_copies_in_small_blocks(spark, monkeypatch):
    """A neighbourhood of long sets is cut by the values in a block, and the links are the same."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 3000, 6000)
    docs = []
    for i in range(24):
        text = base.copy()
        at = rng.integers(0, len(text), int(rng.integers(0, 160)))
        text[at] = rng.integers(5000, 9000, len(at))
        docs.append((i, " ".join(f"w{x}" for x in text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {d: (n, c, c == d) for d, (n, c) in brute(docs).items()}
    for values in (groups.BLOCK_VALUES, 20_000):
        monkeypatch.setattr(groups, "BLOCK_VALUES", values)
        assert as_rows(op.find_components(frame)) == want
    blocks = groups.in_blocks(spark.createDataFrame([(1, i, 5000) for i in range(400)], "g long, id long, n long"), "g", 512, "n")
    sizes = [r["count"] for r in blocks.where("low = high").groupBy("low").count().collect()]
    assert 90 <= len(sizes) <= 100 and sum(sizes) == 400


def test_one_row_of_an_id(spark):
    rows = [(3, "b b b b", 1), (3, "a a a a", 2), (3, None, 3), (4, "c", 4), (4, "c", 4)]
    for parts in (1, 3):
        kept = op.keep_one(spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(parts))
        assert sorted((r.doc_id, r.text, r.extra) for r in kept.collect()) == [(3, "a a a a", 2), (4, "c", 4)]


def test_repeats_null_ids_and_empty_tables(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, None), (1, "a b c d"), (5, "p q r"), (5, "u v w"), (6, "u v w"), (4, "p q r")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in op.find_components(frame).collect()}
    assert got == {(3, 1, False), (None, None, True), (1, 1, True), (5, 4, False), (6, 4, False), (4, 4, True)}
    assert sorted((r.doc_id or 0) for r in op.keep_one(frame).collect()) == [0, 0, 1, 4]
    assert op.find_components(frame.limit(0)).count() == 0
    assert op.keep_one(frame.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 50)]
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: root[x] for p in pairs if p[0] != p[1] for x in p}


def test_rows_follow_from_the_similarity():
    assert (op.NEAR.rows, op.NEAR.hashes) == (12, 72)
    for bands in (op.NEAR, op.Bands(5, 80)):
        assert 2 * (1 - (bands.percent / 100) ** bands.depth) ** bands.rows <= bands.miss
        assert bands.hashes <= 2 * bands.rows * bands.depth
