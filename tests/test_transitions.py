"""Composed session transitions and scans over ranges against one walk from the first call on."""

import json
import random

import pytest
from pyspark.sql import functions as F

from facetledger.operators import sessions as ss
from facetledger.operators import transitions as tr
from facetledger.operators.scan import CHUNK, ROW, in_order, next_value, previous_value, running_min, running_sum

LIMITS = tr.Limits(gap=30 * 60e6, cap=0.75, least=0.5, floor=0.5)


def random_calls(rng, n, confidences):
    out, now, place = [], 0, "/a"
    for i in range(n):
        now += rng.choice([1, 5, 20, 20, 31 if rng.random() < 0.1 else 3]) * 60_000_000
        if rng.random() < 0.05:
            place = rng.choice(["/a", "/b", None])
        value, confidence = rng.choice([("x", rng.choice(confidences)), ("y", rng.choice(confidences)), ("z", rng.choice(confidences)), (None, None)])
        declared = rng.choice([None, None, None, "x", "y", "w"])
        out.append(tr.Call(i, now, now, place, place, declared, value, confidence))
    return out


@pytest.mark.parametrize("confidences", [[0.5, 0.6, 0.85], [0.3, 0.5, 0.74, 0.75, 0.76, 0.9, 1.0], [k / 97 for k in range(40, 98)]])
def test_composed_states_equal_a_walk(confidences):
    rng = random.Random(len(confidences))
    for limits in (LIMITS, tr.Limits(LIMITS.gap, 0.75, 0.3, 0.5), tr.Limits(LIMITS.gap, 0.55, 0.5, 0.6)):
        for _ in range(150):
            calls = random_calls(rng, rng.randint(1, 40), confidences)
            want = list(tr.walk(iter(calls), limits))
            cuts = sorted({0, *(rng.randrange(len(calls)) for _ in range(rng.randint(0, 6)))})
            got, before, state, opened = [], None, None, 0
            for a, b in zip(cuts, [*cuts[1:], len(calls)], strict=True):
                piece = calls[a:b]
                got += list(tr.walk(iter(piece), limits, before, state, opened))
                table = json.loads(json.dumps(tr.Piece(piece, limits).table()))
                state, more = tr.exit_of(table, before, state, limits)
                before, opened = piece[-1], opened + more
            assert got == want


def flipping(n):
    """Each call declares the context that the one before it did not resolve to, which depends on the state it carries."""
    rows = []
    for i in range(n):
        stamp = f"2024-01-01 {i // 60:02}:{i % 60:02}:00"
        weak = i % 3
        rows.append(("s", f"c{i:03}", stamp, "/w", ["personal", "business", "personal", "business"][(i // 2) % 4] if i % 2 else None, ["business", "personal", "unknown"][weak], [0.8, 0.6, 0.9][(i * 7) % 3]))
    return rows


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_dependent_flips_in_a_fixed_number_of_passes(spark, ranges):
    data = flipping(200) + [("t", f"d{i}", f"2024-01-02 00:{i:02}:00", "/w", None, "personal", 0.7) for i in range(5)]
    frame = spark.createDataFrame(data, "session_id string, call_id string, t string, working_directory string, declared string, v string, c double")
    frame = frame.select(
        "session_id", "call_id", F.col("t").cast("timestamp").alias("timestamp"), "working_directory",
        F.when(F.col("declared").isNotNull(), F.create_map(F.lit("context"), F.col("declared"))).otherwise(F.create_map().cast("map<string,string>")).alias("request_tags"),
        F.struct(F.col("v").alias("value"), F.col("c").alias("confidence")).alias("own"),
    )
    calls = [tr.Call(i, i * 60_000_000, i * 60_000_000, "/w", "/w", d, v, c) for i, (_, _, _, _, d, v, c) in enumerate(flipping(200))]
    want = {f"c{i:03}": x for i, x in enumerate(tr.walk(iter(calls), LIMITS))}
    assert sum(reason == "context-change" for reason, _ in want.values()) >= 50
    got = ss.session_decisions(frame.repartition(4), ss.SessionRules(ranges=ranges), F.col("own")).collect()
    assert {r.call_id: (r.reason, r.segment) for r in got if r.session_id == "s"} == want
    assert {(r.reason, r.segment) for r in got if r.session_id == "t"} == {("no-prior", 1), ("continues", 1)}


def test_another_session_than_the_one_followed(spark):
    rows = [("u", "a", "c1", 0), ("u", None, "c2", 1), ("u", "a", "c3", 2), ("u", "b", "c4", 3), ("u", None, "c5", 4), ("u", "a", "c6", 100), ("v", None, "c7", 0), ("v", "a", "c8", 1)]
    frame = spark.createDataFrame([(u, s, c, m) for u, s, c, m in rows], "user_id string, session_id string, call_id string, m int").select(
        "user_id", "session_id", "call_id", F.expr("timestampadd(MINUTE, m, timestamp'2024-01-01')").alias("timestamp"), F.lit("/w").alias("working_directory"),
        F.create_map().cast("map<string,string>").alias("request_tags"),
    )
    for ranges in (1, 6):
        got = ss.session_decisions(frame, ss.SessionRules(ranges=ranges), follow="user_id")
        assert {r.call_id: r.reason for r in got.collect()} == {
            "c1": "no-prior", "c2": "continues", "c3": "continues", "c4": "explicit-id", "c5": "continues", "c6": "explicit-id", "c7": "no-prior", "c8": "explicit-id",
        }


@pytest.mark.parametrize("ranges", [1, 5, 23])
def test_scans_of_one_hot_group_at_one_moment(spark, ranges):
    """A third of the rows are of one group and one second: they are dealt by rows, and the scans are the same."""
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", 0 if i % 3 == 0 else i, f"k{i:04}", None if i % 7 else i) for i in range(1500)] + [(None, 5, f"n{i:03}", i) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, at int, id string, v int").withColumn("g", F.coalesce("g", F.lit("none"))).repartition(6)
    dealt = in_order(frame, ["g"], ["at", "id"], ranges)
    sizes = [r["count"] for r in dealt.groupBy(CHUNK).count().collect()]
    assert len(sizes) == ranges and max(sizes) <= 3 * 1800 / ranges + 20
    found = previous_value(dealt, ["g"], {"before": F.col("v")})
    found = next_value(found, ["g"], {"after": F.col("v")}, inclusive=True)
    found = running_sum(found, ["g"], {"total": F.col("v")})
    found = running_min(found, ["g"], {"least": F.col("v")}, inclusive=False)
    groups = {}
    for g, at, key, v in sorted((r[0] or "none", *r[1:]) for r in rows):
        groups.setdefault(g, []).append((key, v))
    want = {}
    for items in groups.values():
        known = [v for _, v in items]
        for i, (key, _) in enumerate(items):
            earlier, later = [v for v in known[:i] if v is not None], [v for v in known[i:] if v is not None]
            want[key] = (earlier[-1] if earlier else None, later[0] if later else None, sum(v for v in known[: i + 1] if v is not None), min(earlier, default=None))
    assert {r.id: (r.before, r.after, r.total, r.least) for r in found.collect()} == want
    ordered = dealt.orderBy(ROW).collect()
    assert [(r.g, r["at"], r.id) for r in ordered] == sorted((r.g, r["at"], r.id) for r in ordered)
