"""Decontamination against a word-by-word search."""

import re

import pytest
from pyspark.sql import Row

from facetledger.llm import decontaminate
from facetledger.llm.decontaminate import digest, remove_affected, search_items

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in windows:
                    hit.update(range(p, p + k))
                    found |= windows[g]
        out[doc] = (len(w), len(hit), len(found), digest(list(found)))
    return out


def test_whole_tables(spark):
    from facetledger.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in QUERIES["op9_decontamination"](spark, folder).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert got == want
    assert any(w[1] for w in want.values())


DOCS = [
    (1, "a b c d e f g h i j k l m"), (2, "x A B c d E f g h i J y z"), (3, None), (4, ""), (5, "?? -- !!"), (6, "one two"),
    (7, "zero ONE-two three one two"), (8, "b c d e f g h i j"), (9, "été Été a b c d e f g h i j a b c d e f g h i j k"),
    (9, "été Été a b c d e f g h i j a b c d e f g h i j k"), (10, "t t t t t t t t t t t t t"), (11, "q " * 5000 + "a b c d e f g h i j"),
    (None, "one two"),
]
ITEMS = [(1, "a b c d e f g h i j k"), (10, "One, two"), (2, None), (3, "..."), (4, "t " * 11), (5, "a b c d e f g h i j k"), (None, "x a b")]


@pytest.mark.parametrize("block_words", [1_000_000, 12])
def test_cases(spark, block_words):
    docs = spark.createDataFrame([Row(doc_id=d, text=t, n_hit="clash", extra=7) for d, t in DOCS])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = search_items(docs, items, block_words=block_words).collect()
    assert len(rows) == len(DOCS)
    want = brute(DOCS, [i for i in ITEMS if i[0] is not None])
    hit = brute(DOCS, ITEMS)
    for r in rows:
        assert r.extra == 7
        assert (r.n_words, r.n_hit) == hit[r.doc_id][:2], r
        assert (len(r["items"]), digest(r["items"])) == want[r.doc_id][2:], r
    kept = remove_affected(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "p q a b c d e f g h i j k l z"), (2, "b c d e f g h i j k l m")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "o a b c d e f g h i j k l m n")], "item_id long, text string")
    found = {(r.doc_id, *m) for r in search_items(docs.coalesce(1), items).collect() for m in r.matches}
    assert found == {(1, "7", 1, 2, 12), (2, "7", 2, 0, 12)}


@pytest.mark.parametrize("block_words", [1_000_000, 12])
@pytest.mark.parametrize("parts, batch", [(1, 10_000), (1, 1), (4, 10_000)])
def test_every_document_has_its_own_matches(spark, parts, batch, block_words):
    """The whole item, a part of it, several parts, and copies, in one slice or in many."""
    item = "a b c d e f g h i j k l m n".split()
    texts = [item, ["z", *item[1:13]], item, ["x", *item[:10], "y", *item[3:14]], item[:9], ["q"] * 30, [*item[4:], *item]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
    items = spark.createDataFrame([(7, " ".join(item)), (8, "r s t"), (9, "d e f g h i j k l m n o p")], "item_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = {(r.doc_id, *m) for r in search_items(docs, items, block_words=block_words).collect() for m in r.matches}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {
        (0, "7", 0, 0, 14), (2, "7", 0, 0, 14), (1, "7", 1, 1, 12), (3, "7", 0, 1, 10), (3, "7", 3, 12, 11), (6, "7", 0, 10, 14),
        (0, "9", 0, 3, 11), (2, "9", 0, 3, 11), (1, "9", 0, 3, 10), (3, "9", 0, 12, 11), (6, "9", 0, 13, 11),
    }


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert search_items(empty, none).count() == 0
    assert [(r.n_words, r.n_hit, r["items"]) for r in search_items(docs, none).collect()] == [(2, 0, [])]


def test_suffixes_are_sorted():
    import numpy as np

    text = np.array([3, 1, 2, 3, 1, 2, 0, 3, 1, 0])
    order = decontaminate.suffix_array(text, 100).tolist()
    assert order == sorted(range(10), key=lambda k: text[k:].tolist())
