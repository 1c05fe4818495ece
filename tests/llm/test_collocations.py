"""Phrases against counts of all n-grams."""

import re
from collections import Counter

import numpy as np
import pytest
from oracles import connect, spark_rows, sql_rows

from facetledger.llm import collocations as op
from facetledger.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest, top, percent):
    """docs: (lang, text)."""
    counts, totals = {}, Counter()
    for lang, text in docs:
        own = counts.setdefault(lang or "und" if lang != "" else "", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in frequent.items():
            inside = [z for z, b in frequent.items() if len(z) > len(p) and 100 * b >= percent * a and any(z[i : i + len(p)] == p for i in range(len(z)))]
            if not inside:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def got(frame, **options):
    return sorted(map(tuple, op.collocations(frame, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_whole_table_against_sql(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("lang", "text")
    want = brute([tuple(r) for r in docs.collect()], 20, 5, 50, 100)
    assert want and got(docs, least=20, top=50) == want
    assert spark_rows(QUERIES["op11_collocations"](spark, small)) == sql_rows(connect(small), ORACLES["op11_collocations"])


def texts(seed=5, n=120):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "c", "A", "é", "a\x01", "a!b", "x\x00y", " ", "\xa0", "zz", "a\tb"]
    out = []
    for i in range(n):
        some = rng.choice(words, rng.integers(0, 40), p=np.array([6, 5, 4, 3, 2, 1, 1, 1, 1, 1, 1, 1]) / 27)
        out.append((["en", "de", None, ""][i % 4], (" " if i % 3 else "  ").join(some) + ("." if i % 5 else "\n") + "the very same end"))
    return out


@pytest.mark.parametrize("budget", [1 << 20, 40, 3])
@pytest.mark.parametrize("percent", [100, 60])
def test_groups_of_any_size(spark, budget, percent):
    docs = texts() + [(None, None), ("en", ""), ("en", " \t "), ("fr", "once only"), ("de", "a " * 3000)] + [("en", "a b c a b c")] * 30
    frame = spark.createDataFrame([(lang, text, "clash", 7) for lang, text in docs], "lang string, text string, phrase string, n int").repartition(5)
    want = brute(docs, 8, 5, 40, percent)
    assert got(frame, least=8, top=40, percent=percent, budget=budget) == want
    assert {r[0] for r in want} >= {"en", "de", "und", ""}


def test_other_lengths_and_thresholds(spark):
    docs = texts(9, 60)
    frame = spark.createDataFrame(docs, "lang string, text string")
    for least, longest in ((1, 2), (300, 3), (3, 6)):
        assert got(frame, least=least, longest=longest, top=30) == brute(docs, least, longest, 30, 100)
    assert got(frame.limit(0)) == []
    with pytest.raises(ValueError):
        op.collocations(frame, longest=1)


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "p q", 2, 3 * 10**9), ("en", "p", 1, 4 * 10**9), ("en", "q", 1, 5 * 10**9)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    assert op.scored(phrases, totals).first().score == 1000 * 3 * 10**9 * 10**13 // (20 * 10**18)


def test_partition_prolongs_heavy_prefixes():
    tables = {}
    counts = np.zeros(op.PREFIX_BUCKETS, np.int64)
    counts[:4] = [5, 50, 6, 7]
    few = op.PART * op.PREFIX_BUCKETS // op.WORD_BUCKETS
    tables[op.WORDS] = {0: np.concatenate([np.zeros(op.PART // 8, np.uint8), counts[:few].view(np.uint8)])}
    tables[op.RUNS + 1] = {0: (counts // 10).view(np.uint8)}
    parts = op.partition(tables, 3, 10)
    assert parts.heavy[0][:4].tolist() == [False, True, False, False] and not parts.heavy[1].any()
    assert parts.groups[0][:4].tolist() == [0, 0, 1, 1] and parts.groups[1].min() > parts.groups[0].max()
