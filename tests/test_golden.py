"""Hand-made rows with known results."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from facetledger.functions import display, pricing
from facetledger.operators import attribution as at
from facetledger.operators import classify as cl
from facetledger.operators import evaluation as ev
from facetledger.operators import resolve as rs
from facetledger.operators import taxonomy as tx
from facetledger.plans.report import classify_corpus, report
from facetledger.schemas import CALL
from facetledger.sources import api_log, exports, spend_log
from facetledger.streaming import online


def line(day, cost, tags=(), domain="engineering", activity="investigating", failed=False, version=1, **more):
    scored = lambda v, c=0.8: {"value": v, "confidence": c}
    facets = None if failed else {
        "context": scored("business"), "domain": scored(domain), "activity": scored(activity), "project": [scored("auth")],
        "tags": [scored(v, c) for v, c in tags],
    }
    return json.dumps({
        "schema_version": version, "timestamp": f"{day}T12:00:00+00:00", "call_id": f"{day}-{cost}", "session_id": "s", "model": "m",
        "agent": "a", "pipeline_version": None, "cost_usd": cost, "tokens": {"input": 100, "output": 10, "cache_creation": 0, "cache_read": 50},
        "facets": facets, "prompt_prefix": "hi", "classifier_error": "ValueError: bad input" if failed else None, **more,
    })


@pytest.fixture
def log(tmp_path):
    (tmp_path / "spend-2026-04-21.jsonl").write_text(line("2026-04-21", 0.10, [("debugging", 0.8), ("python", 0.6)]) + "\n")
    (tmp_path / "spend-2026-04-22.jsonl").write_text(
        line("2026-04-22", 0.05, [("debugging", 0.7)]) + "\n" + line("2026-04-22", 0.15, [("python", 0.9)]) + "\n"
    )
    (tmp_path / "spend-2026-04-23.jsonl").write_text(
        line("2026-04-23", 0.08, domain="marketing", activity="building") + "\n" + line("2026-04-23", 0.12, failed=True) + "\n"
    )
    return tmp_path


def costs(frame):
    return {r["value"]: float(r["cost_usd"]) for r in frame.collect()}


def test_two_lenses(spark, log):
    spend = at.flatten_spend(spend_log.load_spend(spark, str(log)))
    assert costs(at.any_lens(spend, "tags")) == {"debugging": 0.15, "python": 0.25}
    assert costs(at.primary_lens(spend, "tags")) == {"debugging": 0.15, "python": 0.15, "_untagged": 0.08, "_unknown": 0.12}
    kpi = at.kpis(spend).first()
    assert (round(kpi.total_cost, 6), kpi.total_calls, kpi.classifier_failures, kpi.median_cost) == (0.5, 5, 1, 0.1)
    assert at.lens_invariants(spend_log.load_spend(spark, str(log))).count() == 0


def test_kpis_of_nothing(spark, tmp_path):
    (tmp_path / "spend-2026-04-01.jsonl").write_text("")
    kpi = at.kpis(at.flatten_spend(spend_log.load_spend(spark, str(tmp_path)))).first()
    assert tuple(kpi) == (0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)


@pytest.mark.parametrize("first, last, kept", [(date(2026, 4, 22), None, 4), (None, date(2026, 4, 22), 3), (date(2026, 4, 22), date(2026, 4, 22), 2)])
def test_date_bounds_are_inclusive(spark, log, first, last, kept):
    assert spend_log.load_spend(spark, str(log), first, last).count() == kept
    assert at.by_date(spend_log.load_spend(spark, str(log)), first, last).count() == kept


def test_rejects_are_counted(spark, log):
    more = ["", "not json", line("2026-04-24", 1.0, version=99), line("2026-04-24", 2.0, timestamp="soon"), "[1]",
            line("2026-04-24", None), line("2026-04-24", 3.0, facets=5)]
    (log / "spend-2026-04-24.jsonl").write_text("\n".join(more) + "\n")
    tagged = spend_log.tag_lines(spend_log.read_lines(spark, str(log)))
    stats = spend_log.load_stats(tagged).first()
    assert (stats.files_seen, stats.rows_seen, stats.rows_kept, stats.rows_skipped_blank) == (4, 12, 5, 1)
    assert (stats.rows_skipped_parse, stats.rows_skipped_schema, stats.rows_classifier_error) == (5, 1, 1)
    assert {r[0]: r[1] for r in spend_log.version_histogram(tagged).collect()} == {1: 5, 99: 1}


def test_round_trip_through_daily_files(spark, log, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    rows = spend_log.load_spend(spark, str(log))
    spend_log.append_daily(rows, out)
    back = spend_log.load_spend(spark, out)
    assert spend_log.load_spend(spark, out, date(2026, 4, 22), date(2026, 4, 22)).count() == 2
    key = lambda f: sorted(map(str, f.select("call_id", "timestamp", "cost_usd", "facets", "tokens").collect()))
    assert key(back) == key(rows)


def test_fingerprint_follows_changes(spark, log):
    before = spend_log.fingerprint(spark, str(log)).collect()
    assert before == spend_log.fingerprint(spark, str(log)).collect()
    with open(log / "spend-2026-04-23.jsonl", "a") as file:
        file.write(line("2026-04-23", 0.01) + "\n")
    assert before != spend_log.fingerprint(spark, str(log)).collect()


def test_report_and_upkeep(spark, log, tmp_path_factory):
    tables = report(spark, str(log), days=2, today=date(2026, 4, 23))
    assert tables["summary"].first().calls == 4
    assert costs(tables["tags/any"]) == {"debugging": 0.05, "python": 0.15}
    target = str(tmp_path_factory.mktemp("parquet"))
    online.compact(spark, str(log), target)
    assert spark.read.parquet(target).groupBy("month").count().collect()[0]["count"] == 5
    csv = str(tmp_path_factory.mktemp("csv")) + "/pivot"
    at.write_pivot_csv(spend_log.load_spend(spark, str(log)), csv)
    assert spark.read.option("header", True).csv(csv).filter("facet = 'tags' and lens = 'any'").count() == 2


def test_report_counts_the_whole_log(spark, log):
    (log / "spend-2025-01-01.jsonl").write_text("\n".join(["not json", line("2025-01-01", 1.0, version=99), line("2025-01-01", 1.0), line("2026-04-23", 0.5)]) + "\n")
    tables = report(spark, str(log), days=2, by=[], today=date(2026, 4, 23))
    stats = tables["load"].first()
    assert (stats.files_seen, stats.rows_seen, stats.rows_kept) == (4, 9, 5)
    assert (stats.rows_skipped_parse, stats.rows_skipped_schema, stats.rows_skipped_date) == (1, 1, 2)
    assert {r[0]: r[1] for r in tables["versions"].collect()} == {1: 7, 99: 1}
    assert tables["summary"].first().calls == 5


def test_spend_stream_reads_each_file_once(spark, log, tmp_path_factory):
    out, mark = (str(tmp_path_factory.mktemp(n)) for n in ("s", "m"))
    run = lambda: online.write_until_done(spend_log.kept_rows(online.read_spend_stream(spark, str(log))), out, mark)
    run()
    (log / "spend-2026-04-25.jsonl").write_text(line("2026-04-25", 0.2) + "\n")
    run()
    assert spark.read.parquet(out).count() == 6


def calls(spark, **fields):
    base = {"call_id": "c", "messages": [], "tool_calls": [], "request_tags": {}, "in_prompt": {"hashtags": [], "commands": []}}
    return spark.createDataFrame([{**base, **fields}], CALL)


def found(frame, **classifiers):
    rows = cl.with_candidates(frame, classifiers).select(F.inline("candidates")).collect()
    return [(r["value"], r["confidence"], r["source"]) for r in rows]


def say(*texts, role="user"):
    return [{"role": role, "content": t} for t in texts]


def test_rule_classifiers(spark):
    assert found(calls(spark, working_directory="/home/me/taxes/dev/"), c=cl.context_rules) == [("personal", 0.85, "workdir-personal-fragment")]
    assert found(calls(spark), c=cl.context_rules) == [("unknown", 0.5, "default-unknown")]
    assert found(calls(spark, git_context={"branch": "HotFix/x"}), a=cl.activity_rules) == [("investigating", 0.9, "git-branch-prefix-hotfix")]
    touched = [{"name": "Edit", "arguments": {"file_path": "/a/Login_Test.py"}}]
    assert found(calls(spark, tool_calls=touched), a=cl.activity_rules) == [("verifying", 0.8, "test-file-path")]
    assert found(calls(spark, messages=say("decode this")), d=cl.domain_keywords) == [("engineering", 0.6, "keywords-1-hits")]
    assert found(calls(spark, messages=say("hello")), d=cl.domain_keywords) == [("unknown", 0.4, "default-unknown")]
    assert found(calls(spark, working_directory="/x/app/\\"), p=cl.project_workdir) == [("app", 0.8, "workdir-basename")]


def test_project_signals(spark):
    frame = calls(
        spark, request_tags={"project": "p1"}, messages=say("see AUTH-45 and BILL-456", "AUTH-45 again") + say("NOPE-12", role="assistant"),
        in_prompt={"hashtags": ["project:p2", "project:", "x"], "commands": [{"name": "new-project", "args": " p3 domain=x"}, {"name": "project", "args": " "}]},
        git_context={"repo": "r", "branch": "feat/AUTH-45-and-Z9-1-AB-123456"},
    )
    assert [v[0] for v in found(frame, p=cl.project_explicit)] == ["p1", "p2", "p3"]
    assert [v[0] for v in found(frame, p=cl.project_ticket_ref)] == ["AUTH-45", "BILL-456"]
    assert found(frame, p=cl.project_git_branch) == [("AUTH-45", 0.85, "git-branch-ticket")]
    assert cl.with_candidates(frame, {"t": cl.project_team_registry}).first()["candidates"] == []


def test_keyword_tagger_counts_whole_words(spark):
    assert found(calls(spark, messages=say("The category of catalogues")), t=cl.keyword_tagger) == []
    hits = found(calls(spark, messages=say("Pet food, puppies; a Kitten. éalbum album")), t=cl.keyword_tagger)
    assert hits == [("music", 0.5, "keyword-1-hits"), ("pets", 0.8, "keyword-3-hits")]


def test_all_five_facets_on_a_rich_call(spark):
    frame = calls(
        spark, working_directory="/Users/dev/repos/auth-service", git_context={"repo": "auth-service", "branch": "fix/oauth-timeout"},
        messages=say("there is a bug in the code, refactor the function"),
    )
    verdicts = rs.classify(frame).first()["classifications"]
    assert {v["facet"] for v in verdicts} == {"context", "domain", "activity", "project", "tags"}
    projects = [(v["value"], v["confidence"]) for v in verdicts if v["facet"] == "project"]
    assert projects == [("auth-service", 0.95)]


def test_array_ties_keep_first_seen_order(spark):
    make = lambda v, c: cl.verdict("tags", F.lit(v), c, "s", "n")
    given = lambda: F.array(make("a", 0.5), make("b", 0.8), make("a", 0.8), make("low", 0.39), make("c", 0.41))
    got = rs.classify(calls(spark), {"x": given}).first()["classifications"]
    assert [(v["value"], v["confidence"]) for v in got] == [("a", 0.8), ("b", 0.8), ("c", 0.41)]


def test_facet_lists_keep_null_and_empty_apart(spark):
    frame = spark.range(1).select(F.lit(None).cast(cl.VERDICTS).alias("none"), cl.none().alias("empty"))
    row = frame.select(rs.facet_lists(F.col("none")).alias("a"), rs.facet_lists(F.col("empty")).alias("b")).first()
    assert row["a"] is None and row["b"] is not None and row["b"]["tags"] is None


TREE = {"a": {"description": "first", "children": {"x": {}, "y": {"children": {"z": None}}}}, "b": None}


def test_taxonomy_tree(spark):
    nodes = tx.nodes_from_mapping(spark, TREE)
    assert {r["id"] for r in tx.leaves(nodes).collect()} == {"a/x", "a/y/z", "b"}
    assert {r["id"]: r["depth"] for r in tx.with_paths(nodes).collect()} == {"a": 1, "b": 1, "a/x": 2, "a/y": 2, "a/y/z": 3}
    assert tx.node_problems(nodes).count() == 0
    seeds = spark.createDataFrame([(1, "a/y/z"), (1, "nope")], "q int, node_id string")
    assert {r["id"] for r in tx.prune(nodes, seeds, "q").collect()} == {"a", "a/y", "a/y/z"}
    assert [r["node_id"] for r in tx.unknown_seeds(nodes, seeds).collect()] == ["nope"]
    for bad in ({"a/b": {}}, {"a": {"child": {}}}, {"a": 3}):
        with pytest.raises(ValueError):
            tx.nodes_from_mapping(spark, bad)


def test_walk_ends_early_and_rejects(spark):
    edges = [("a", "a/x", 0.7), ("a", "a/y", 0.9), ("a/y", "a/y/z", 0.6), (None, "a", 0.9), (None, "b", 0.8)]
    frame = spark.createDataFrame([([dict(zip(("parent_id", "id", "score"), e), ord=0) for e in edges],)], tx.SUBTREE.join(["subtree ", ""]))
    paths = frame.select(tx.similarity_walk(F.col("subtree")).alias("w")).first()["w"]
    # Roots a and b fill the beam; b ends at once, then a's two children fill it, and x ends before z.
    assert [(p["path"][-1], p["confidences"][-1]) for p in paths] == [("b", 0.8), ("a/x", 0.7), ("a/y/z", 0.6)]
    cut = frame.select(tx.reject(F.array(F.lit("r"), F.lit("s"), F.lit("t")), F.array(F.lit(0.9), F.lit(0.7), F.lit(0.9))).alias("p")).first()["p"]
    assert cut["path"] == ["r"]
    assert frame.select(tx.reject(F.array(F.lit("r")), F.array(F.lit(0.84))).alias("p")).first()["p"] is None


def test_hash_embedder_is_deterministic(spark):
    embed = tx.hash_embedder(16)
    assert (embed(["x"]) == embed(["x"])).all() and not (embed(["x"]) == embed(["y"])).all()


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "g boolean, p boolean")
    got = ev.binary_metrics(rows, F.col("g"), F.col("p")).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.precision, got.recall, got.f1, got.accuracy) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    sets = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["a", "c"])], "g array<string>, p array<string>")
    assert round(ev.set_metrics(sets, "g", "p").first().macro_f1, 6) == 0.5
    same = spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string")
    assert ev.cohens_kappa(same, "a", "b").first().kappa == 1.0
    bound = spark.range(1).select(ev.wilson_bounds(F.lit(8), F.lit(10)).alias("w"), ev.wilson_bounds(F.lit(0), F.lit(0)).alias("z")).first()
    assert (round(bound["w"]["low"], 3), round(bound["w"]["high"], 3), tuple(bound["z"])) == (0.49, 0.943, (0.0, 0.0))


def test_money_and_prices(spark):
    row = spark.range(1).select(
        display.money(F.lit(1234.5)).alias("a"), display.money(F.lit(1.5)).alias("b"), display.money(F.lit(0.01)).alias("c"),
        display.money(F.lit(0.0001)).alias("d"), display.age(F.lit(7200.0)).alias("e"), display.percent(F.lit(None).cast("double")).alias("f"),
        pricing.estimate_cost(F.lit("claude-haiku-x"), F.lit(1_000_000), F.lit(0)).alias("g"),
    ).first()
    assert tuple(row) == ("$1,234", "$1.50", "$0.0100", "$0.000100", "2.0h ago", "—", 0.8)


def test_transcripts_are_not_classified_but_cost(spark):
    body = json.dumps({"model": "claude-opus-4", "messages": [{"role": "user", "content": "older topic"}, {"role": "user", "content": "<transcript> all"}]})
    reply = json.dumps({"content": [], "usage": {"input_tokens": 1_000_000, "output_tokens": 0}})
    log = spark.createDataFrame([("c", body, reply, '{"X-Claude-Code-Session-Id": "s"}')], "call_id string, request_body string, response_body string, headers string")
    row = online.logged_calls(log.withColumn("timestamp", F.current_timestamp())).first()
    assert (float(row.cost_usd), row.facets, row.session_id) == (15.0, None, "s") and row.classifier_error.startswith("skipped")


def test_tree_export_follows_parents(spark, tmp_path):
    message = lambda i, role, text: {"id": i, "author": {"role": role}, "content": {"parts": [text, {"image": 1}]}, "create_time": 1.0, "metadata": {}}
    mapping = {
        "r": {"parent": None, "message": None}, "n1": {"parent": "r", "message": message("m1", "user", " first ")},
        "dead": {"parent": "n1", "message": message("m2", "user", "dead")}, "n2": {"parent": "n1", "message": message("m3", "assistant", "reply")},
        "n3": {"parent": "n2", "message": message("m4", "user", "second")},
    }
    (tmp_path / "conversations-1.json").write_text(json.dumps([{"conversation_id": "c", "mapping": mapping, "current_node": "n3"}]))
    export = exports.read_tree_export(spark, str(tmp_path))
    got = [(r["call_id"], r["messages"][0]["content"]) for r in exports.tree_export_calls(export).collect()]
    assert got == [("m1", "first"), ("m4", "second")]
    paired = exports.with_reply_messages(exports.tree_turns(export)).orderBy("position").collect()
    assert [[m["content"] for m in r["messages"]] for r in paired] == [["first", "reply"], ["second"]]


def test_flat_content_and_usage(spark):
    texts = ['"plain"', '[{"type":"text","text":"a"},{"type":"image"},"b"]', "5"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(api_log.flatten_content(F.parse_json("t")).alias("x"))
    assert [r["x"] for r in frame.collect()] == ["plain", "a\nb", ""]


def test_corpus_sink(spark, small, tmp_path):
    from facetledger.sources.tables import event_calls
    from facetledger.operators.sessions import SessionRules

    some = event_calls(spark, small).drop("cost_usd").filter("session_id in ('u1', 'u2')")
    job = classify_corpus(some, str(tmp_path / "out"), rules=SessionRules(gap_minutes=600, arc_gap_minutes=240))
    records = {r.call_id: r for r in spark.read.json(str(tmp_path / "out/records")).collect()}
    assert {c: r.text for c, r in records.items()} == {r.call_id: r.messages[0].content[:200] for r in some.collect()}
    assert {(r.call_id, len(r.classifications)) for r in records.values()} == {(r.call_id, len(r.classifications)) for r in job.final.collect()}
    assert job.changes.filter("phase = 'pass-1'").select("call_id").distinct().count() == some.count()
    meta = spark.read.json(str(tmp_path / "out/meta")).first()
    assert meta.total_messages == some.count() and meta.total_sessions == 2
