"""Typed stream state: order, expiry, bounded state, state read back, and the incremental sink."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from facetledger.operators import resolve as rs
from facetledger.operators import sessions as ss
from facetledger.sources.tables import event_calls
from facetledger.streaming import fold, online

RULES = ss.SessionRules(gap_minutes=600, arc_gap_minutes=240, anchor_min_chars=45)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def calls(spark, small):
    from facetledger.runtime import stage

    return stage(event_calls(spark, small).filter("user_id in ('user-1', 'user-2', 'user-3', 'user-7', 'user-9')"))


def streamed(spark, calls, folder, batches, build, mode="labels"):
    """Runs a stream over the calls in so many micro-batches, given as a column of the batch number, and its checkpoint."""
    source = f"{folder}/in"
    for k in range(batches):
        calls.filter(F.col("_batch") == k).drop("_batch").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(calls.drop("_batch").schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    online.write_until_done(build(stream), f"{folder}/out", f"{folder}/log")
    return spark.read.parquet(f"{folder}/out")


def fold_of(calls, rules=RULES):
    """Events of a call-by-call fold whose timers act between the calls and after the last one."""
    by_session, out = defaultdict(list), []
    last = calls.agg(F.max(F.unix_micros("timestamp") / 1e6)).first()[0]
    for row in online.prepared(calls, rules).collect():
        by_session[row["session_id"]].append(row.asDict())
    for session, rows in by_session.items():
        state = fold.new_state()
        for row in sorted(rows, key=lambda r: (r["at"], r["call_id"])):
            out += [{"session_id": session, **e} for e in fold.step(state, {**row, "candidates": [c.asDict() for c in row["candidates"]]}, rules)]
        if last - state["history"][-1]["at"] > rules.arc_gap_minutes * 60:
            out += [{"session_id": session, **e} for e in fold.close(state, rules)]
    return {tuple(e.get(c) for c in ("session_id", "call_id", "kind", "facet", "value", "confidence", "source")) for e in out}


def test_calls_in_reverse_batches_give_the_order_of_time(spark, calls, tmp_path):
    """Later calls arrive first, within the watermark: the labels are those of the order of their times."""
    days = F.floor(F.unix_seconds("timestamp") / 86_400)
    first, last = calls.agg(F.min(days), F.max(days)).first()
    numbered = calls.withColumn("_batch", F.when(F.col("call_id") == calls.agg(F.max_by("call_id", "timestamp")).first()[0], F.lit(3)).otherwise(2 - F.floor(3 * (days - first) / (last - first + 1))))
    delay = f"{last - first + 1} days"
    records = streamed(spark, numbered, str(tmp_path), 4, lambda s: online.label_sessions(s, RULES, delay))
    assert records.count() == 0  # the watermark has not passed any call
    late = numbered.withColumn("timestamp", F.col("timestamp") + F.expr(f"interval {2 * (last - first + 1)} days")).withColumn("session_id", F.lit("later")).limit(1).withColumn("_batch", F.lit(0))
    late.drop("_batch").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    online.write_until_done(online.label_sessions(stream, RULES, delay), f"{tmp_path}/out", f"{tmp_path}/log")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").filter("session_id <> 'later' and kind <> 'arc-without-anchor'").collect()}
    want = {e for e in fold_of(calls.unionByName(late.drop("_batch"))) if e[0] != "later" and e[2] != "arc-without-anchor"}
    assert {e[2] for e in want} == {"verdict", "back-propagation", "revision"}
    assert got == want
    # Sessions that the watermark has left behind have no state any more; the last one does.
    assert {r.session_id for r in online.read_state(spark, f"{tmp_path}/log", "calls").collect()} <= {"later"}
    assert online.read_facets(spark, f"{tmp_path}/log").filter("session_id <> 'later'").count() == 0


def test_facets_are_read_back_and_begin_another_stream(spark, calls, tmp_path):
    """get, update and clear: a session's facets as of the last batch, and a stream that begins with others."""
    one = calls.filter("session_id = 'u1'").withColumn("_batch", F.lit(0))
    streamed(spark, one, f"{tmp_path}/a", 1, lambda s: online.label_sessions(s, RULES, "0 seconds"))
    held = {r.facet: (r.value, r.confidence) for r in online.read_facets(spark, f"{tmp_path}/a/log", "u1").collect()}
    assert "activity" in held and online.read_facets(spark, f"{tmp_path}/a/log", "nobody").count() == 0
    changed = spark.createDataFrame([("u1", "domain", "legal", 1.0, "manual", "c0"), ("u1", "context", "personal", 0.6, "manual", "c0")], "session_id string, facet string, value string, confidence double, source string, call_id string")
    first = one.orderBy("timestamp", "call_id").limit(1)
    records = streamed(spark, first, f"{tmp_path}/b", 1, lambda s: online.label_sessions(s, RULES, "0 seconds", {"none": lambda: F.array().cast("array<struct<facet:string,value:string,confidence:double,source:string,classifier_name:string,alternatives:array<struct<value:string,confidence:double>>,metadata:map<string,string>>>")}, initial=changed))
    assert records.filter("kind = 'verdict'").count() == 0  # the first call opens a session: what was held is cleared


def test_weak_calls_keep_bounded_state():
    rules = ss.SessionRules(arc_gap_minutes=1)
    weak = {"facet": "domain", "value": "legal", "confidence": 0.6, "source": "s"}
    state = fold.new_state()
    for i in range(10_000):
        fold.step(state, {"session_id": "s", "call_id": f"c{i}", "at": 120.0 * i, "workdir": None, "declared": None, "anchor": True, "candidates": [weak]}, rules)
        fold.forget(state, rules, reach=3600)
        assert len(state["history"]) <= 32


def test_arcs_without_an_anchor_are_labelled_from_their_calls(spark, calls, tmp_path):
    numbered = calls.withColumn("_batch", F.lit(0))
    records = streamed(spark, numbered, str(tmp_path), 1, lambda s: online.label_sessions(s, RULES, "0 seconds"))
    reported = {(r.session_id, r.call_id) for r in records.filter("kind = 'arc-without-anchor'").collect()}
    labels = online.silent_arc_labels(records, calls.filter("session_id is not null"), RULES).collect()
    assert reported and labels
    arcs = {r.call_id: r.arc_id for r in ss.with_arcs(calls, RULES.arc_gap_minutes).collect()}
    assert {arcs[r.call_id] for r in labels} == {f"{s}:{c}" for s, c in reported}
    assert {r.source for r in labels} == {ss.FROM_ARC + a for a in {arcs[r.call_id] for r in labels}}


def test_rolling_state_over_several_batches(spark, calls, tmp_path):
    own = calls.filter("session_id is not null").withColumn("_batch", F.ntile(3).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("timestamp", "call_id")) - 1)
    # Spark loses a plain column of a file stream below the generators of a classification; a computed one it keeps.
    build = lambda s: online.session_state(rs.classify(s.withColumn("cost_usd", F.col("cost_usd") + F.lit(0))), "0 seconds", 366 * 24 * 60)
    states = streamed(spark, own, str(tmp_path), 3, build)
    totals = {r.call_id: (float(r.total_cost_usd), r.call_count) for r in ss.session_totals(rs.classify(calls.filter("session_id is not null"))).collect()}
    assert {r.call_id: (round(r.total_cost_usd, 6), r.call_count) for r in states.collect()} == totals
    kept = online.read_state(spark, f"{tmp_path}/log", "totals")
    assert {r.session_id: r.calls for r in kept.collect()} == {r.session_id: r["n"] for r in own.groupBy("session_id").agg(F.count("*").alias("n")).collect()}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    batch = lambda rows: spark.createDataFrame(rows, "day string, model string, calls long")
    online.upsert(batch([("d1", "a", 1), ("d1", "b", 2), ("d2", "a", 3)]), 0, path, ["day", "model"], "day")
    files = lambda day: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "table" / f"day={day}").glob("*.parquet"))
    untouched = files("d1")
    for _ in range(2):
        online.upsert(batch([("d2", "a", 5), ("d3", "c", 1)]), 1, path, ["day", "model"], "day")
    online.upsert(batch([("d2", "a", 3)]), 0, path, ["day", "model"], "day")  # an old batch, played again
    assert files("d1") == untouched
    got = {(r.day, r.model): r.calls for r in spark.read.parquet(path).collect()}
    assert got == {("d1", "a"): 1, ("d1", "b"): 2, ("d2", "a"): 5, ("d3", "c"): 1}


def test_late_windows_are_dropped_and_others_updated(spark, tmp_path):
    rows = [(0, "2024-01-01 10:00:00", 1.0), (1, "2024-01-05 10:00:00", 2.0), (2, "2024-01-05 10:30:00", 1.0), (3, "2024-01-01 11:00:00", 50.0), (3, "2024-01-05 11:00:00", 3.0)]
    frame = spark.createDataFrame(rows, "_batch int, t string, cost_usd double").withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    for k in range(4):
        frame.filter(F.col("_batch") == k).drop("_batch").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.drop("_batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live = online.rollup(stream, "1 day", "1 hour").withColumn("day", F.to_date("window_start"))
    online.upsert_until_done(live, f"{tmp_path}/out", f"{tmp_path}/log", ["window_start"], "day")
    got = {str(r.day): (r.calls, r.cost_usd) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"2024-01-01": (1, 1.0), "2024-01-05": (3, 6.0)}

