"""Runs against all periods of all stretches."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from facetledger.llm import periodic_runs as op
from facetledger.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x):
    """(start, length, period) of all runs, by start, then period."""
    n, out = len(x), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def expected(words):
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    said = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    return runs, (*best, 1000 * best[1] // best[2]) if best else (None,) * 4, hashlib.sha256(said.encode()).hexdigest(), kept


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_whole_table(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = QUERIES["op13_periodic_runs"](spark, small).collect()
    assert len(found) == len(docs) and sum(r.n_runs > 0 for r in found) > 5
    for r in found:
        words = looped(r.doc_id, WORD.findall(docs[r.doc_id] or ""))
        if len(words) <= 1500:
            runs, best, said, kept = expected(words)
            assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli), r.runs_sha256, r.collapsed_sha256) == (len(runs), best, said, hashlib.sha256(kept.encode()).hexdigest())


def odd_texts():
    rng = np.random.default_rng(3)
    out = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "a A a A a A a A", "a b " * 4, ("a b " * 4)[:-3], "x " + "a b c " * 5 + "y", "été été  été\têté\nété été", "a\x0bb\x0ca\rb a b a b", "a\xa0a " * 6, "a\x1fa " * 6]
    out += ["a a a a a a b " * 7, "p " * 5000, "k " * 11 + "l " * 13, " ".join(f"w{i}" for i in range(300)) + " " + " ".join(f"w{i}" for i in range(300))]
    long_period = " ".join(f"w{i}" for i in range(333))
    out += [f"{long_period} " * 4 + "w0 w1", " ".join([long_period] * 4)[:-4], "s " + f"{long_period} z z z z z z z " * 5]
    out += [" ".join(rng.choice(["a", "b", "c"][: k % 3 + 1], rng.integers(1, 90))) for k in range(60)]
    for _ in range(40):
        parts = [" ".join(rng.choice(["a", "b"], rng.integers(1, 6)).tolist() * int(rng.integers(1, 8))) for _ in range(4)]
        out.append(" ".join(parts))
    return out


def test_odd_texts(spark):
    texts = odd_texts()
    rows = [(k if k % 9 else None, t, 1, "clash") for k, t in enumerate(texts)] + [(3, "a " * 8, 1, "clash")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, period string").repartition(3)
    got = sorted(repr((r.doc_id, r.n_words, list(zip(r.starts, r.lengths, r.periods, strict=True)), (r.start, r.length, r.period, r.exponent_milli), r.runs_sha256, r.collapsed)) for r in op.periodic_runs(frame).collect())
    want = []
    for doc, text, *_ in rows:
        words = WORD.findall(text or "")
        runs, best, said, kept = expected(words)
        want.append(repr((doc, len(words), runs, best, said, kept)))
    assert got == sorted(want)
    assert op.periodic_runs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        op.periodic_runs(frame, collapse="no")


def test_many_random_texts():
    rng = np.random.default_rng(0)
    for _ in range(150):
        docs = [rng.integers(0, rng.integers(1, 5), rng.integers(0, 70)) for _ in range(3)] + [np.tile(rng.integers(0, 3, rng.integers(1, 12)), rng.integers(1, 9))]
        first = np.cumsum([0, *map(len, docs)])
        doc = np.repeat(np.arange(len(docs)), np.diff(first))
        start, end, period = op.find_runs(*op.word_numbers(np.concatenate(docs).astype(np.uint64), doc), first)
        want = [(a + first[k], a + first[k] + length, q) for k, d in enumerate(docs) for a, length, q in brute(d.tolist())]
        assert list(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == want


def test_sums_of_squares_are_exact():
    rng = np.random.default_rng(1)
    for length in (1, 2, 16, 256):
        blocks, windows = rng.integers(0, 70_000, (4, length)), rng.integers(0, 70_000, (4, 2 * length))
        windows[0, :length] = blocks[0]
        found = op.square_sums(blocks, windows)
        bits = op.digit_bits(length, int(max(blocks.max(), windows.max())))
        digits = [(x[:, None, :] >> np.arange(0, 17, bits)[None, :, None]) & ((1 << bits) - 1) for x in (blocks, windows)]
        for o in range(length):
            assert (found[:, o] == ((digits[0] - digits[1][:, :, o : o + length]) ** 2).sum((1, 2))).all()
        x = rng.integers(0, op.PRIME, (3, 2 * length)).astype(np.uint64)
        assert (op.backward(op.forward(x)) == x).all()


def test_one_word_a_million_times_is_linear():
    n = 1_000_000
    start, end, period = op.find_runs(*op.word_numbers(np.zeros(n, np.uint64), np.zeros(n, np.int64)), np.array([0, n]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [n], [1])
