"""Line dedup against all pairs of lines."""

import re

import numpy as np
import pytest
from pyspark.sql import Row

from facetledger.llm import line_dedup as op
from facetledger.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, percent=80):
    """doc -> (lines, removed, links, class) and the remaining texts, by comparing every two sets."""
    places, sets = {}, {}
    for doc, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            words = frozenset(WORD.findall(line.translate(LOWER)))
            if words and doc is not None:
                places.setdefault(words, []).append((doc, k))
                sets[doc, k] = words
    every = sorted(places, key=len)
    linked = {s: set() for s in every}
    for i, s in enumerate(every):
        for t in every[i + 1 :]:
            if 100 * len(s) < percent * len(t):
                break
            common = len(s & t)
            if 100 * common >= percent * (len(s) + len(t) - common):
                linked[s].add(t)
                linked[t].add(s)
    group = {}
    for s in every:
        todo, members = [s], set()
        while todo and s not in group:
            x = todo.pop()
            if x not in members:
                members.add(x)
                todo += linked[x]
        for x in members:
            group[x] = members
    out, texts = {}, {}
    for doc, text in docs:
        lines = text.split("\n") if text else []
        mine = [sets.get((doc, k)) for k in range(len(lines))]
        gone = [k for k, s in enumerate(mine) if s and (doc, k) > min(min(places[t]) for t in {s, *linked[s]})]
        classes = [min(p[0] for x in group[s] for p in places[x]) for s in mine if s]
        out[doc] = (len(lines), len(gone), sum(len(linked[s]) for s in mine if s), min(classes, default=doc))
        texts[doc] = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out, texts


def as_rows(frame):
    return {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.class_id) for r in frame.collect()}


def test_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want, _ = brute(docs)
    assert as_rows(QUERIES["op10_line_dedup"](spark, small)) == want
    assert any(w[1] for w in want.values()) and any(w[2] for w in want.values())


def near_lines(seed, lines=160):
    """Lines that differ from a few others in some words, so that similarities lie around the threshold."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [rng.choice(words, rng.integers(1, 40), replace=False).tolist() for _ in range(8)]
    out = []
    for _ in range(lines):
        line = list(bases[rng.integers(8)])
        for _ in range(rng.integers(0, max(1, len(line) // 4) + 1)):
            line[rng.integers(len(line))] = words[rng.integers(300)]
        out.append(" ".join(line))
    return out


@pytest.mark.parametrize(("cell", "block", "at_once"), [(20_000, 512, 1 << 21), (6, 5, 40)])
def test_near_lines(spark, monkeypatch, cell, block, at_once):
    lines = near_lines(3)
    docs = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "...\n!!"), (104, "A b\nb, a.\nB A c"), (105, "x " * 30_000), (106, "x"), (-5, "ü x y z q\nü x y z")]
    monkeypatch.setattr(op, "CELL", cell)
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "PAIRS_AT_ONCE", at_once)
    frame = spark.createDataFrame([Row(doc_id=d, text=t, n="clash", line=1) for d, t in docs], "doc_id long, text string, n string, line int").repartition(3)
    want, texts = brute(docs)
    assert as_rows(op.summary(frame)) == want
    if cell == 6:
        kept = op.without_later_matches(frame)
        assert kept.columns == frame.columns
        assert {r.doc_id: r.text for r in kept.collect()} == texts


def test_long_lines(spark):
    """Lines with more words than the short parities can tell apart, at similarities around the threshold."""
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(3000)]
    docs = []
    for size in (190, 210, 320, 900):
        base = rng.choice(words, size, replace=False).tolist()
        for k in range(14):
            line = list(base)
            for j in rng.choice(size, int(size * 0.012 * k), replace=False):
                line[j] = words[rng.integers(3000)]
            docs.append((len(docs), " ".join(line)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want, _ = brute(docs)
    assert as_rows(op.summary(frame)) == want
    assert 0 < sum(w[2] for w in want.values()) < 4 * 14 * 13


def test_cells_meet_once(monkeypatch):
    monkeypatch.setattr(op, "CELL", 10)
    counts = np.full(op.COUNT_BUCKETS, 35)
    rank = op.rarity(counts)
    assert op.cells_of(op.keys_of(np.arange(3, dtype=np.uint64) << np.uint64(46), rank), rank).tolist() == [4, 4, 4]


def test_repeats_null_ids_and_empty_tables(spark):
    frame = spark.createDataFrame([(2, "a b c"), (2, "a b c"), (None, "a b c"), (3, "a b c\nd")], "doc_id long, text string")
    assert as_rows(op.summary(frame)) == {2: (1, 0, 0, 2), None: (1, 0, 0, None), 3: (2, 1, 0, 2)}
    assert op.summary(frame.limit(0)).count() == 0


def test_keys_tell_hashes_apart():
    """One key for each 64-bit hash, ordered by the counts of the buckets."""
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50_000, op.COUNT_BUCKETS)
    rank = op.rarity(counts)
    hashes = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    near = np.concatenate([hashes, hashes ^ np.uint64(1)])  # apart in the last bit only
    keys = op.keys_of(near, rank)
    assert len(np.unique(keys)) == len(np.unique(near))
    order = np.argsort(keys)
    assert (np.diff(counts[op._bucket(near[order])]) >= 0).all()
    assert (op.cells_of(keys, rank) * op.CELL >= counts[op._bucket(near)]).all()


def test_kept_columns_may_have_any_name(spark):
    frame = spark.createDataFrame([(1, "a b c d\nx y", 1, "p"), (2, "d c b a\nnew one here", 2, "q")], "doc_id long, text string, _gone int, lines string")
    got = {r.doc_id: (r.text, r._gone, r.lines) for r in op.without_later_matches(frame).collect()}
    assert got == {1: ("a b c d\nx y", 1, "p"), 2: ("new one here", 2, "q")}


def test_entries_are_packed(spark, monkeypatch):
    """An entry of a line of up to 64 words takes 22 bytes, of up to 200 words 31; every cell lies in one part, a set goes to
    each cell of a word once, and sets of one cell meet if their subsets are the cell's."""
    monkeypatch.setattr(op, "CELL", 10)
    lines = near_lines(5, 300) + [" ".join(f"z{j}" for j in range(k, k + 90)) for k in range(3)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(101)], "doc_id long, text string").repartition(3)
    rank = spark.sparkContext.broadcast(op.rarity(op.word_counts(docs)))
    sets = op.distinct_sets(docs.mapInArrow(op._liner(rank, 80), op.LINES)).cache()
    found = sets.collect()
    assert len(found) == len({r.id for r in found}) == len({frozenset(x.split()) for x in lines})
    shared, many = op.shared_words(sets, rank)
    prefixes = {r.id: np.frombuffer(r.prefix, np.uint64) for r in found}
    assert many == sum(int(op.cells_of(p, rank.value).sum()) for p in prefixes.values())
    blobs = op.entries(sets, rank, spark.sparkContext.broadcast(shared), 7).collect()
    want = sum(int(op.cells_of(p, rank.value)[shared[op._shared_place(p)]].sum()) for p in prefixes.values())
    assert sum(len(r.rows) // op.KINDS[r.kind].itemsize for r in blobs) == want
    assert [k.itemsize for k in op.KINDS[:2]] == [22, 31] and {r.kind for r in blobs} == {0, 1}
    where, met = {}, {}
    for r in blobs:
        for x in np.frombuffer(r.rows, op.KINDS[r.kind]):
            assert where.setdefault(int(x["meet"]), r.part) == r.part
            met.setdefault(int(x["meet"]), []).append((int(x["id"]), int(x["at"]) & 3))
    assert all(len({i for i, _ in m}) == len(m) for m in met.values())
    together = {frozenset((a, b)) for m in met.values() for a, s in m for b, t in m if a != b and (s == 0 or s != t)}
    assert together == {frozenset((a, b)) for a in prefixes for b in prefixes if a != b and set(prefixes[a].tolist()) & set(prefixes[b].tolist())}
