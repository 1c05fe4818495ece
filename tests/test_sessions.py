"""The parallel session job against a call-by-call fold of the same rules."""

import json
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from facetledger.operators import resolve as rs
from facetledger.operators import sessions as ss
from facetledger.sources.tables import event_calls
from facetledger.streaming import fold, online

RULES = ss.SessionRules(gap_minutes=600, arc_gap_minutes=240, anchor_min_chars=45, ranges=7)


@pytest.fixture(scope="module")
def calls(spark, small):
    return event_calls(spark, small).drop("cost_usd")


@pytest.fixture(scope="module")
def classified(calls):
    from facetledger.runtime import stage

    return stage(ss.classify_sessions(calls, rules=RULES))


@pytest.fixture(scope="module")
def job(calls):
    return ss.run_sessions(calls, rules=RULES)


@pytest.fixture(scope="module")
def folded(spark, calls, classified):
    """Final verdicts, pass-1 verdicts and audit of the fold, session by session."""
    arcs = ss.with_arcs(classified, RULES.arc_gap_minutes)
    marked = arcs.withColumn("is_anchor", ss.is_anchor(RULES.anchor_min_chars))
    silent = ss.arc_eligibility(marked, F.col("is_anchor")).filter("reason = 'no-anchors'").select("arc_id")
    texts = arcs.drop("classifications", "pipeline_version", "reason", "is_new", "segment").join(silent, "arc_id", "left_semi")
    by_arc = {
        r["arc_id"]: [{"facet": v["facet"], "value": v["value"], "confidence": v["confidence"], "source": v["source"]} for v in r["classifications"]]
        for r in ss.arc_verdicts(texts, rules=RULES).select("arc_id", "classifications").collect()
    }
    by_session = defaultdict(list)
    for row in online.prepared(calls, RULES).collect():
        by_session[row["session_id"]].append(row.asDict())
    first, final, events = set(), set(), []
    for session, rows in by_session.items():
        state = fold.new_state()
        for row in sorted(rows, key=lambda r: (r["at"], r["call_id"])):
            events += fold.step(state, {**row, "candidates": [c.asDict() for c in row["candidates"]]}, RULES, by_arc.__getitem__)
        fold.flush(state, RULES, by_arc.__getitem__)
        for entry in state["history"]:
            final |= {(entry["call_id"], v["facet"], v["value"], v["confidence"], v["source"]) for v in entry["verdicts"]}
    first = {(e["call_id"], e["facet"], e["value"], e["confidence"], e["source"]) for e in events if e["kind"] == "verdict"}
    updates = {(e["call_id"], e["facet"], e["value"], e["source"]) for e in events if e["kind"] == "back-propagation"}
    return first, final, updates, by_arc


def rows(frame):
    long = rs.long_form(frame.filter("session_id is not null"), "call_id")
    return {tuple(r) for r in long.select("call_id", "facet", "value", "confidence", "source").collect()}


def test_pass_one_equals_fold(classified, folded):
    assert rows(classified) == folded[0]


def test_inheritance_and_boundaries_occur(classified):
    reasons = {r[0] for r in classified.select("reason").distinct().collect()}
    assert {"no-prior", "time-gap", "workdir-change", "context-change", "continues", None} <= reasons
    assert any(source.startswith(ss.INHERITED) for *_, source in rows(classified))


def test_session_job_equals_fold(job, folded):
    got = rows(job.final)
    assert got == folded[1]
    kinds = {source.split("-from-")[0] for *_, source in got if "-from-" in source}
    assert {"session-inherited", "back-propagated", "anchor-inherited", "arc-revision"} <= kinds
    updates = {(r["call_id"], r["facet"], r["new_value"], ss.FROM_TRIGGER + r["triggered_by"]) for r in job.updates.collect()}
    assert updates == folded[2]


def test_changes_fold_to_the_final_verdicts(job):
    """The log of changes gives the last verdicts, and each change begins where the one before it ended."""
    assert rows(ss.verdicts_as_of(job.changes)) == rows(job.final)
    log = defaultdict(list)
    for r in job.changes.collect():
        plain = lambda verdicts: [(v["value"], v["confidence"], v["source"]) for v in verdicts]
        log[r.call_id, r.facet].append((r.step, r.phase, plain(r.old), plain(r.new)))
    assert {phase for entries in log.values() for _, phase, _, _ in entries} == set(ss.PHASES)
    for entries in log.values():
        entries.sort()
        for (_, _, _, after), (_, _, before, _) in zip(entries, entries[1:]):
            assert before == after


@pytest.mark.parametrize("day", [3, 9, 17])
def test_changes_up_to_a_moment_equal_a_shorter_log(spark, calls, job, folded, day):
    """As of a moment: what a fold of the calls up to it has, without the end of the log."""
    moment = calls.agg(F.min("timestamp")).first()[0] + timedelta(days=day)
    got = rows(ss.verdicts_as_of(job.changes, F.lit(moment)))
    by_session, want = defaultdict(list), set()
    for row in online.prepared(calls.filter(F.col("timestamp") <= F.lit(moment)), RULES).collect():
        by_session[row["session_id"]].append(row.asDict())
    for items in by_session.values():
        state = fold.new_state()
        for row in sorted(items, key=lambda r: (r["at"], r["call_id"])):
            fold.step(state, {**row, "candidates": [c.asDict() for c in row["candidates"]]}, RULES, folded[3].__getitem__)
        for entry in state["history"]:
            want |= {(entry["call_id"], v["facet"], v["value"], v["confidence"], v["source"]) for v in entry["verdicts"]}
    assert want and got == want


@pytest.mark.parametrize("ranges", [1, 60])
def test_the_job_is_the_same_for_any_number_of_ranges(calls, job, ranges):
    from dataclasses import replace

    assert rows(ss.run_sessions(calls, rules=replace(RULES, ranges=ranges)).final) == rows(job.final)


def test_arcs_as_units_equal_a_fold(calls, folded):
    """Arc mode: one result an arc, state carried from arc to arc, boundaries by the arc's first call."""
    arcs = ss.with_arcs(calls, RULES.arc_gap_minutes)
    bounds = {r.arc_id: r for r in arcs.groupBy("arc_id").agg(F.min("timestamp").alias("begin"), F.max_by(F.struct("call_id", "working_directory"), F.struct("timestamp", "call_id")).alias("last")).collect()}
    made = ss.synthetic_calls(arcs)
    ready = {r.call_id[4:]: r for r in online.prepared(made, RULES).collect()}
    by_session, want = defaultdict(list), {}
    for arc, r in ready.items():
        by_session[r.session_id].append((r["at"], bounds[arc].last.call_id, arc, r))
    for items in by_session.values():
        held, before = {}, None
        for at, last, arc, r in sorted(items, key=lambda x: x[:2]):
            if before and (bounds[arc].begin.timestamp() - before[0] > RULES.gap_minutes * 60 or (before[1] and r.workdir and before[1] != r.workdir) or (before[2] and r.declared and before[2] != r.declared)):
                held = {}
            inherited = [{"facet": f, "value": s["value"], "confidence": min(s["confidence"], RULES.inherit_cap), "source": ss.INHERITED + s["call_id"]} for f, s in held.items()]
            verdicts = fold.resolve([c.asDict() for c in r.candidates] + sorted(inherited, key=lambda c: list(fold.FACETS).index(c["facet"])))
            for v in verdicts:
                if v["confidence"] > held.get(v["facet"], {"confidence": 0.0})["confidence"] and v["confidence"] >= RULES.min_inherit:
                    held = {**held, v["facet"]: {**v, "call_id": last}}
            context = next((v["value"] for v in verdicts if v["facet"] == "context"), None)
            before = (bounds[arc].last and at, bounds[arc].last.working_directory, context)
            want[arc] = {(v["facet"], v["value"], v["confidence"], v["source"]) for v in verdicts}
    got = defaultdict(set)
    for r in rs.long_form(ss.classify_arcs(calls, rules=RULES).filter("session_id is not null"), "arc_id").collect():
        got[r.arc_id].add((r.facet, r.value, r.confidence, r.source))
    assert got == want


def test_stream_verdicts_equal_batch(spark, small, classified):
    from facetledger.plans.corpus_queries import run_stream, stream_calls

    records = run_stream(spark, online.label_sessions(stream_calls(spark, small), RULES, "0 seconds"))
    streamed = {tuple(r) for r in records.filter("kind = 'verdict'").select("call_id", "facet", "value", "confidence", "source").collect()}
    assert streamed == rows(classified)


def folded_tags(rows, top_n, **fading):
    by_session, want = defaultdict(list), set()
    for row in rows:
        by_session[row["session_id"]].append(row)
    for items in by_session.values():
        state = []
        for row in sorted(items, key=lambda r: (r["timestamp"], r["call_id"])):
            state = fold.merge_turn(state, [t.asDict() for t in row["tags"]], top_n=top_n, **fading)
            want |= {(row["call_id"], t["value"], t["confidence"], t["turns_since_seen"]) for t in state}
    return want


@pytest.mark.parametrize("top_n, ranges", [(5, 1), (5, 40), (1, 13), (2, 90)])
def test_fading_tags_equal_fold(spark, small, top_n, ranges):
    from facetledger.plans.session_queries import turns

    own = turns(spark, small).select("session_id", "timestamp", "call_id", F.filter("classifications", lambda c: c["facet"] == "tags").alias("tags"))
    states = ss.tag_states(own, top_n, ranges)
    assert {tuple(r) for r in states.select("call_id", F.inline("tags")).collect()} == folded_tags(own.collect(), top_n)


@pytest.mark.parametrize("factor, floor", [(0.7, 0.3), (0.95, 0.3), (0.5, 0.1), (1.0, 0.3)])
@pytest.mark.parametrize("ranges", [1, 4, 9, 30])
def test_tags_that_compete_over_borders(spark, ranges, factor, floor):
    """Equal confidences, repeated over the border, before the cap cuts; and many tags, where no border is clean."""
    steady = [["A"], *[["B", "A"]] * 7, ["C", "D", "E", "F"]]
    busy = [[chr(65 + (i * k) % 23) for k in range(1, 5)] for i in range(40)]
    rows = [(s, f"{s}{i:02}", f"2024-01-01 {i // 6:02}:{i % 6}0:00", [(t, 0.8 if len(tags) > 2 and t > "H" or t in "CDEF" else 0.5) for t in tags])
            for s, turns in (("x", steady), ("y", busy)) for i, tags in enumerate(turns)]
    frame = spark.createDataFrame(rows, "session_id string, call_id string, t string, tags array<struct<value:string,confidence:double>>")
    frame = frame.withColumn("timestamp", F.col("t").cast("timestamp"))
    states = ss.tag_states(frame, 5, ranges, factor, floor)
    assert {tuple(r) for r in states.select("call_id", F.inline("tags")).collect()} == folded_tags(frame.collect(), 5, factor=factor, floor=floor)


def test_an_arc_is_revised_once():
    anchor = {"facet": "domain", "value": "legal", "confidence": 0.8, "source": "s"}
    call = lambda i, at, **more: {"session_id": "s", "call_id": f"c{i}", "at": at, "workdir": None, "declared": None, "anchor": False, "candidates": [], **more}
    state = fold.new_state()
    fold.step(state, call(0, 0.0, anchor=True, candidates=[anchor]), RULES)
    fold.step(state, call(1, 10.0), RULES)
    timer = [e for e in fold.close(state, RULES) if e["kind"] == "revision"]
    later = [e for e in fold.step(state, call(2, 10.0 + RULES.arc_gap_minutes * 60 + 1), RULES) if e["kind"] == "revision"]
    assert len(timer) == 1 and later == []


def test_forgetting_history_changes_nothing(spark, calls):
    by_session = defaultdict(list)
    for row in online.prepared(calls, RULES).collect():
        by_session[row["session_id"]].append(row.asDict())
    for items in by_session.values():
        kept, short = fold.new_state(), fold.new_state()
        for row in sorted(items, key=lambda r: (r["at"], r["call_id"])):
            call = {**row, "candidates": [c.asDict() for c in row["candidates"]]}
            assert fold.step(kept, call, RULES) == fold.step(short, json.loads(json.dumps(call, default=str)), RULES)
            fold.forget(short, RULES)


def test_arc_limit_is_inclusive(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:04:00", "2024-01-01 00:09:00", "2024-01-01 00:15:00"]
    frame = spark.createDataFrame([("s", f"c{i}", t) for i, t in enumerate(times)], "session_id string, call_id string, t string")
    arcs = ss.with_arcs(frame.withColumn("timestamp", F.col("t").cast("timestamp")), 5)
    assert {r["call_id"]: r["arc_id"] for r in arcs.collect()} == {"c0": "s:c0", "c1": "s:c0", "c2": "s:c0", "c3": "s:c3"}


def test_arc_text_keeps_the_tail(spark):
    frame = spark.createDataFrame(
        [("s", f"c{i}", f"2024-01-01 00:0{i}:00", ch * 40) for i, ch in enumerate("abc")], "session_id string, call_id string, t string, text string"
    ).selectExpr("session_id", "call_id", "cast(t as timestamp) as timestamp", "array(named_struct('role', 'user', 'content', text)) as messages")
    arcs = ss.with_arcs(frame, 5)
    assert [r["text"] for r in ss.arc_text(arcs, 60).collect()] == [("b" * 40 + "\n\n" + "c" * 40)[-60:]]


def test_affirmations_are_followers(spark):
    texts = ["yes", "Sounds good!", "please refactor the whole authentication module today"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "array(named_struct('role', 'user', 'content', text)) as messages")
    got = {r["text"]: (r["a"], r["b"]) for r in frame.select("text", ss.is_anchor().alias("a"), ss.is_anchor(1).alias("b")).collect()}
    assert got == {"yes": (False, False), "Sounds good!": (False, False), texts[2]: (True, True)}
