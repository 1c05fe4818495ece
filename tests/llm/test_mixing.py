"""Source mixing against a slot-by-slot schedule."""

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetledger.llm import mixing as op
from facetledger.llm.queries import MIXTURE, QUERIES


def simulate(blocks, shares):
    """The order of (source, block), a slot at a time, and the largest deviation from the weights in any phase."""
    left, out, worst = {s: n for s, n in blocks.items() if n}, [], Fraction(0)
    done = Counter()
    while left:
        total = sum(shares[s] for s in left)
        weight = {s: Fraction(shares[s], total) for s in left}
        taken, t = Counter(), 0
        while all(left.values()):
            free = [s for s in left if int(taken[s] / weight[s]) <= t]
            s = min(free, key=lambda s: (-((-(taken[s] + 1) / weight[s]) // 1), s is None, s or ""))
            out.append((s, done[s]))
            done[s] += 1
            taken[s] += 1
            left[s] -= 1
            t += 1
            worst = max([worst, *(abs(taken[x] - weight[x] * t) for x in left)])
        left = {s: n for s, n in left.items() if n}
    return out, worst


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1))
def test_phases_are_the_schedule(sources):
    blocks, shares = {s: x[0] for s, x in sources.items()}, {s: x[1] for s, x in sources.items()}
    want, worst = simulate(blocks, shares)
    got = {}
    for p in op.phases(blocks, shares):
        for s, slots in p.slots.items():
            for i in range(p.taken[s]):
                got[p.start + i // len(slots) * p.period + slots[i % len(slots)]] = (s, p.before[s] + i)
    assert [got[t] for t in range(len(want))] == want and len(got) == len(want)
    assert worst < 1


def test_whole_table(spark, small):
    rows = QUERIES["op4_source_mixing"](spark, small).collect()
    counts = Counter(r.source for r in rows)
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    weights = {s: MIXTURE.get(s, min(MIXTURE.values())) for s in counts}
    assert len(set(weights.values())) > 5
    order, worst = simulate({s: -(-n // op.BLOCK_DOCS) for s, n in counts.items()}, op.exact_shares(weights))
    assert worst < 1
    slots = {x: t for t, x in enumerate(order)}
    for r in rows:
        assert r.slot == slots[r.source, r.block] and r.release <= r.slot < r.deadline and r.position // op.BLOCK_DOCS == r.slot
    assert len({r.position for r in rows}) == len(rows)


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_odd_sources(spark, monkeypatch, chunk):
    monkeypatch.setattr(op.numbered, "__defaults__", ("source", chunk))
    rows = [(i, f"t{i}", "hot", "x") for i in range(100)] + [(200 + i, None, None, "y") for i in range(9)]
    rows += [(300, "same", "rare", "z")] * 3 + [(None, "n", "rare", "z"), (400, "", "", "e"), (401, "w" * 100_000, "zero", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string").repartition(5)
    weights = {"hot": 1.0, None: 2.0, "rare": 5.0, "zero": 0.0, "absent": 9.0}
    got = op.interleave(docs.drop("slot"), weights, block_docs=4, period=20).collect()
    assert len(got) == len(rows)
    counts = Counter(r.source for r in got)
    shares = op.whole_shares({s: weights.get(s, 1.0) for s in counts}, 20)
    order, worst = simulate({s: -(-n // 4) for s, n in counts.items()}, shares)
    assert worst < 1
    slots, sizes = {x: t for t, x in enumerate(order)}, defaultdict(int)
    for r in got:
        assert r.slot == slots[r.source, r.block]
        sizes[r.source, r.block] += 1
    assert sizes["hot", 24] == 4 and sizes["rare", 0] == 4 and sizes[None, 2] == 1
    kept = op.in_order(docs, weights, 4)
    assert kept.columns == docs.columns and kept.count() == len(rows) and kept.where("slot = 'x'").count() == 100
    if chunk > 7:
        first = [r.source for r in op.in_order(docs, weights, 4).collect()]
        assert first[:4] == [order[0][0]] * 4


def test_empty_and_bad_weights(spark):
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert op.interleave(empty).count() == 0
    with pytest.raises(ValueError, match="weights"):
        op.whole_shares({"a": 0.0})
    assert op.whole_shares({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}


def deviation(order, weights):
    """The largest distance of any source from slot * weight, in blocks, while all sources have blocks."""
    total, worst, taken, left = sum(weights.values()), Fraction(0), Counter(), Counter(order)
    for t, s in enumerate(order, 1):
        taken[s] += 1
        worst = max([worst, *(abs(taken[x] - t * w / total) for x, w in weights.items())])
        if taken[s] == left[s]:
            return worst


@pytest.mark.parametrize("given_weights", [None, {"s0": 0.7, "s1": 0.2999, "s2": 0.0001}, {"s0": 1 / 3, "s1": 0.123456789, "s2": 1e-25}])
def test_deviation_from_the_given_weights(spark, given_weights):
    docs = spark.range(2400).selectExpr("id doc_id", "concat('s', id % 3) source")
    exact = {f"s{k}": Fraction(repr(given_weights[f"s{k}"])) if given_weights else Fraction(1) for k in range(3)}
    rows = sorted(op.interleave(docs, given_weights, block_docs=1).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(2400)) and all(r.release <= r.slot < r.deadline for r in rows)
    assert deviation([r.source for r in rows], exact) < 1
    total = sum(exact.values())
    for r in rows[: next(r.slot for r in rows if r.block == 799) + 1]:  # until the first source is out of blocks
        share = exact[r.source] / total
        assert (r.release, r.deadline) == (r.block // share, min(-(-(r.block + 1) // share), op.LONG))


def test_many_equal_and_idle_sources(spark):
    docs = spark.range(21 * 90).selectExpr("id doc_id", "concat('s', id % 21) source")
    rows = sorted(op.interleave(docs, block_docs=1).collect(), key=lambda r: r.slot)
    assert all(r.slot // 21 == r.block and r.release == r.block * 21 and r.deadline == r.release + 21 for r in rows[: 89 * 21])
    rows = op.interleave(docs, {"s0": 0, "s1": 0.0, "s2": 3}, block_docs=1).collect()
    assert {r.source for r in rows if r.slot >= 19 * 90} == {"s0", "s1"} and len({r.slot for r in rows}) == 21 * 90
