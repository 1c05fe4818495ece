"""Toxicity: texts of any length are learned from."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from facetledger.llm import toxicity as op
from facetledger.llm.queries import QUERIES
from facetledger.llm.text import buffer_of
import pyarrow as pa


def test_learns_from_long_texts(spark):
    rng = random.Random(3)
    calm, vile = [f"calm{k}" for k in range(40)], ["filth", "vile", "scum", "trash"]
    texts = [" ".join(rng.choices(calm, k=6)) + (f" {rng.choice(vile)} {rng.choice(vile)}. " if i % 2 else ". ") for i in range(300) for _ in range(20)]
    rows = [(i, "".join(texts[20 * i : 20 * i + 20])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    for limit in (op.LIMIT_BYTES, 100):  # above and below the length of every text
        chain = op.fit(docs, labels, limit_bytes=limit)
        assert chain is not None
        found = op.score(docs, chain).collect()
        assert all(r.predicted == r.doc_id % 2 for r in found)


def random_chain(seed):
    rng = np.random.default_rng(seed)
    return op.Chain(rng.normal(size=op.BUCKETS).astype(np.float32), rng.normal(size=(2, 2)), rng.normal(size=2))


@pytest.mark.parametrize("seed", range(4))
def test_marginals_equal_the_sum_over_all_tag_sequences(seed):
    texts = ["one two three. four five", "", "solo", "a b c d e f g! h", "x\ny z", "été Über 12 ..."]
    data, offsets = buffer_of(pa.array(texts))
    tokens, chain = op.tokens_of(data, offsets), random_chain(seed)
    toxic, pairs, starts, log_z = chain.marginals(tokens)
    emission = chain.weights[tokens.features].sum(1)
    want, want_pairs, want_starts, want_log = np.zeros(len(toxic)), np.zeros((2, 2)), np.zeros(2), 0.0
    for s in np.unique(tokens.sentence):
        at = np.flatnonzero(tokens.sentence == s)
        scores = {}
        for tags in itertools.product((0, 1), repeat=len(at)):
            score = chain.starts[tags[0]] + sum(emission[i] for i, t in zip(at, tags, strict=True) if t) + sum(chain.transitions[a, b] for a, b in zip(tags, tags[1:]))
            scores[tags] = math.exp(score)
        z = sum(scores.values())
        want_log += math.log(z)
        for tags, score in scores.items():
            p = score / z
            want_starts[tags[0]] += p
            for i, t in zip(at, tags, strict=True):
                want[i] += p * t
            for a, b in zip(tags, tags[1:]):
                want_pairs[a, b] += p
    assert np.allclose(toxic, want) and np.allclose(pairs, want_pairs) and np.allclose(starts, want_starts) and math.isclose(log_z, want_log, rel_tol=1e-6)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_documents_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = QUERIES["op3_toxicity"](spark, folder).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    unseen = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    bad, good = [s for s, t in unseen if t], [s for s, t in unseen if not t]
    assert len(bad) >= 5 and len(good) >= 50
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert above > 0.9


def test_spans_are_bytes_of_the_text_and_odd_rows_have_results(spark):
    rng = random.Random(5)
    calm = [f"ruhig{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choices(calm, k=30)) + (" schmutzé dreck. " if i % 2 else ". ") + " ".join(rng.choices(calm, k=30))) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)] + [(1, 0), (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = op.fit(docs, labels)
    odd = [(1000, None, 1, "a"), (1001, "", 2, "b"), (1002, " .!? \n", 3, "c"), (None, "über schmutzé dreck, ruhig1", 4, "d"), (1003, "ruhig2 " * 50_000 + ". schmutzé dreck", 5, "e"), (1004, "x" * 300_000, 6, "f")]
    frame = spark.createDataFrame(odd + odd[:4], "doc_id long, text string, score int, other string").repartition(3)
    found = op.score(frame, chain)
    assert set(found.columns) == {"doc_id", "text", "other", "score", "predicted", "spans"}
    got = found.collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault((r.doc_id, r.text), (r.score, r.predicted, r.spans)) == (r.score, r.predicted, r.spans)
        raw = (r.text or "").encode()
        for span in r.spans:
            assert 0 <= span.start < span.end <= len(raw) and raw[span.start : span.end].decode()
    marked = next(r for r in got if r.doc_id is None)
    assert [marked.text.encode()[s.start : s.end].decode() for s in marked.spans] == ["schmutzé dreck"]
    calmest = {r.score for r in got if r.doc_id in (1000, 1001, 1002)}
    assert len(calmest) == 1 and calmest.pop() < 0.5
    assert op.score(frame.limit(0), chain).count() == 0


def test_without_labels_every_score_is_zero(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(5, 1)], [(1, None)]):
        chain = op.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {(r.doc_id, r.score, r.predicted) for r in op.score(docs, chain).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
