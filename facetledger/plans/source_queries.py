"""Reading and writing logs: spend lines, raw API bodies, streamed events and chat exports, built from the tables."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from facetledger.functions import pricing
from facetledger.operators import attribution as at
from facetledger.operators import resolve as rs
from facetledger.operators.classify import keyword_tagger
from facetledger.plans.cost_queries import SPEND_CTE
from facetledger.plans.label_queries import CALLS_CTE, TAGS_SQL, calls
from facetledger.plans.registry import plain, query
from facetledger.runtime import checkpoint_dir
from facetledger.sources import api_log, exports, spend_log
from facetledger.sources.tables import conversation_turns, load, spend_rows

FIRST, LAST = date(1997, 1, 1), date(1998, 12, 31)


def spend_lines(spark, sf_dir):
    """Spend rows as log lines; some are blank, broken, of another version, or without a readable time."""
    rows = spend_rows(spark, sf_dir)
    day = F.date_format("timestamp", "yyyy-MM-dd")
    part = F.element_at(F.split("call_id", "-"), 3).cast("bigint")
    line = spend_log.spend_line()
    bad = (
        F.when(part % 101 == 0, F.lit("  "))
        .when(part % 101 == 1, F.lit("this is not json"))
        .when(part % 101 == 2, F.regexp_replace(line, '"schema_version":1', '"schema_version":99'))
        .when(part % 101 == 3, F.regexp_replace(line, '"timestamp":"[^"]*"', '"timestamp":"yesterday"'))
        .when(part % 101 == 4, F.regexp_replace(line, '"cost_usd":[0-9.]+', '"cost_usd":null'))
        .when(part % 101 == 5, F.lit("[1, 2]"))
        .when(part % 101 == 6, F.regexp_replace(line, '"facets":\\{', '"facets":7,"old":{'))
        .when(part % 101 == 7, F.regexp_replace(line, '("facets":\\{.*)"classifier_error":null', '$1"classifier_error":"late: no metadata"'))
        .otherwise(line)
    )
    return rows.select(bad.alias("line"), F.concat(F.lit("spend-"), day, F.lit(".jsonl")).alias("file"))


REJECT_SQL = f"""{SPEND_CTE}, tagged AS (SELECT *, l_partkey % 101 AS m, CASE
  WHEN l_partkey % 101 = 0 THEN 'blank' WHEN l_partkey % 101 IN (1, 5) THEN 'parse' WHEN l_partkey % 101 = 2 THEN 'schema'
  WHEN l_partkey % 101 IN (3, 4) THEN 'parse' WHEN l_partkey % 101 = 6 AND l_linenumber <> 7 THEN 'parse'
  WHEN local_date < DATE '{FIRST}' OR local_date > DATE '{LAST}' THEN 'date' END AS reject FROM spend)"""


@query(
    "load_stats",
    f"""{REJECT_SQL} SELECT count(DISTINCT local_date) AS files_seen, count(*) AS rows_seen, count(*) FILTER (WHERE reject IS NULL) AS rows_kept,
  count(*) FILTER (WHERE reject = 'blank') AS rows_skipped_blank, count(*) FILTER (WHERE reject = 'parse') AS rows_skipped_parse,
  count(*) FILTER (WHERE reject = 'schema') AS rows_skipped_schema, count(*) FILTER (WHERE reject = 'date') AS rows_skipped_date,
  count(*) FILTER (WHERE reject IS NULL AND classifier_failed) AS rows_classifier_error,
  count(*) FILTER (WHERE reject IS NULL AND m = 7 AND l_linenumber <> 7) AS rows_meta_skipped FROM tagged""",
)
def load_stats(spark, sf_dir):
    return spend_log.load_stats(spend_log.tag_lines(spend_lines(spark, sf_dir), FIRST, LAST))


@query(
    "schema_versions",
    f"{REJECT_SQL} SELECT CASE WHEN m = 2 THEN 99 ELSE 1 END AS schema_version, count(*) AS rows FROM tagged WHERE coalesce(reject, 'x') NOT IN ('blank', 'parse') GROUP BY 1",
)
def schema_versions(spark, sf_dir):
    return spend_log.version_histogram(spend_log.tag_lines(spend_lines(spark, sf_dir), FIRST, LAST))


@query(
    "spend_log_scan",
    f"{REJECT_SQL} SELECT primary_tag, domain, count(*) AS calls, round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd, CAST(sum(tokens_input) AS BIGINT) AS tokens_input, "
    "min(session_id) AS first_session FROM tagged WHERE reject IS NULL GROUP BY ALL",
)
def spend_log_scan(spark, sf_dir):
    kept = spend_log.kept_rows(spend_log.tag_lines(spend_lines(spark, sf_dir), FIRST, LAST))
    wide = at.flatten_spend(kept)
    return plain(
        wide.groupBy("primary_tag", "domain").agg(
            F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"), F.sum("tokens_input").alias("tokens_input"),
            F.min("session_id").alias("first_session"),
        )
    )


@query(
    "flatten_spend",
    f"{SPEND_CTE} SELECT call_id, context, domain, activity, primary_project, primary_tag, len(projects) AS n_projects, len(tags) AS n_tags, "
    "classifier_failed, total_input_tokens FROM spend",
)
def flatten_spend(spark, sf_dir):
    return at.flatten_spend(spend_rows(spark, sf_dir)).select(
        "call_id", "context", "domain", "activity", "primary_project", "primary_tag",
        F.size("projects").cast("bigint").alias("n_projects"), F.size("tags").cast("bigint").alias("n_tags"), "classifier_failed", "total_input_tokens",
    )


@query(
    "timestamps_parsed",
    "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') "
    "ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS utc FROM events",
)
def timestamps_parsed(spark, sf_dir):
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(iso, F.lit("Z"))).when(kind == 1, F.concat(iso, F.lit("+02:00"))).when(kind == 2, iso).otherwise(F.lit("noon"))
    rows = load(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return rows.select("event_id", F.date_format(spend_log.parse_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query(
    "tokens_normalized",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE event_id + 1 END AS input, "
    "CASE WHEN event_id % 5 = 4 THEN 0 ELSE 7 END AS output, 0 AS cache_creation, CASE WHEN event_id % 5 = 3 THEN 3 ELSE 0 END AS cache_read FROM events",
)
def tokens_normalized(spark, sf_dir):
    usage = F.expr(
        "case event_id % 5 when 0 then map('input', cast(event_id as string), 'input_tokens', '5', 'output_tokens', '7') "
        "when 1 then map('input', cast(null as string), 'input_tokens', '5', 'output', '7') when 2 then map('input_tokens', 'many', 'output', '7') "
        "when 3 then map('input_tokens', cast(event_id + 1 as string), 'output', '7', 'cache_read_tokens', '3') "
        "else map('input_tokens', cast(event_id + 1 as string)) end"
    )
    return load(spark, sf_dir, "events").select("event_id", spend_log.normalize_tokens(usage).alias("t")).select("event_id", "t.*")


@query(
    "facet_lists",
    f"{TAGS_SQL} SELECT calls.call_id, CASE WHEN workdir LIKE '%/taxes/%' THEN 'personal' WHEN workdir LIKE '%/repos/%' THEN 'business' ELSE 'unknown' END AS context, "
    "string_agg(concat(tags.value, ':', CAST(tags.confidence AS VARCHAR)), ',' ORDER BY tags.confidence DESC, tags.ord) FILTER (WHERE tags.value IS NOT NULL) AS tags "
    "FROM calls LEFT JOIN tags ON tags.call_id = calls.call_id GROUP BY ALL",
)
def facet_lists(spark, sf_dir):
    from facetledger.operators.classify import context_rules

    classified = rs.classify(calls(spark, sf_dir), {"context": context_rules, "tags": keyword_tagger})
    shaped = classified.select("call_id", rs.facet_lists(F.col("classifications")).alias("f"))
    listed = F.transform("f.tags", lambda t: F.concat(t["value"], F.lit(":"), t["confidence"].cast("string")))
    return shaped.select("call_id", F.col("f.context.value").alias("context"), F.array_join(listed, ",").alias("tags"))


@query(
    "spend_records",
    f"{CALLS_CTE} SELECT call_id, 1 AS schema_version, concat('model-', uid % 3) AS model, CASE WHEN value < 20 THEN 'cli' ELSE 'ide' END AS agent, "
    "round(value / 100.0, 6) AS cost_usd, left(text, 20) AS prompt_prefix, k AS input, CASE WHEN k % 10 = 3 THEN NULL ELSE CASE WHEN workdir LIKE '%/taxes/%' THEN 'personal' "
    "WHEN workdir LIKE '%/repos/%' THEN 'business' ELSE 'unknown' END END AS context FROM calls",
)
def spend_records(spark, sf_dir):
    from facetledger.operators.classify import context_rules
    from facetledger.sources.tables import event_calls

    classified = rs.classify(event_calls(spark, sf_dir), {"context": context_rules})
    text = F.get("messages", F.lit(0))["content"]
    k = F.get_json_object("props", "$.k")
    usage = load(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("call_id"), F.create_map(F.lit("input_tokens"), k).alias("usage")
    )
    rows = classified.join(usage, "call_id").withColumns(
        {
            "prompt_text": text,
            "classifications": F.when(F.col("usage")["input_tokens"].cast("int") % 10 != 3, F.col("classifications")),
            "classifier_error": F.lit(None).cast("string"),
        }
    )
    made = spend_log.spend_records(rows, 20)
    return plain(
        made.select("call_id", "schema_version", "model", "agent", "cost_usd", "prompt_prefix", F.col("tokens.input").alias("input"),
                    F.col("facets.context.value").alias("context"))
    )


@query("last_row_per_id", "SELECT user_id AS id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_row_per_id(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    return spend_log.last_per_id(rows, F.col("event_id"))


@query(
    "keyed_lines",
    "SELECT concat('d', doc_id) AS id, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE 'first' END AS version, lang FROM documents WHERE doc_id % 7 <> 5",
)
def keyed_lines(spark, sf_dir):
    """Samples kept as JSON lines, some written again later and some lines broken: the last line of an id counts."""
    docs = load(spark, sf_dir, "documents").selectExpr("doc_id", "concat('d', doc_id) as id", "lang")
    path = f"{checkpoint_dir(spark).rstrip('/')}/keyed-{uuid.uuid4().hex}"
    line = lambda version: F.to_json(F.struct("id", F.lit(version).alias("version"), "lang"), {"ignoreNullFields": "false"})
    broken = F.when(F.col("doc_id") % 7 == 5, F.lit("{broken")).otherwise(line("first"))
    docs.select(broken.alias("value")).write.text(f"{path}/part=1")
    docs.filter("doc_id % 3 = 0 and doc_id % 7 <> 5").select(line("again").alias("value")).write.text(f"{path}/part=2")
    return spend_log.load_keyed(spark, path, "id string, version string, lang string").select("id", "version", "lang")


# --- raw API log ---


def api_rows(spark, sf_dir):
    """Conversations as raw API bodies: user turns as requests, in the several shapes a log can hold."""
    turns = load(spark, sf_dir, "conversations")
    return turns.selectExpr(
        "concat('m', conv_id, '-', turn) as call_id", "timestamp'2024-01-01 00:00:00' as timestamp",
        "to_json(named_struct('model', case turn % 4 when 0 then 'claude-opus-4-20250514' when 1 then 'claude-haiku-9' when 2 then 'other' end, "
        "'system', if(conv_id % 3 = 0, null, concat('You help.\\nPrimary working directory: /srv/app', conv_id % 5, if(conv_id % 2 = 0, '/', ''), ' \\n', "
        "'Is a git repository: ', if(conv_id % 4 = 0, 'false', 'TRUE'), '\\nCurrent branch: fix/x-', turn, '\\nEnd')), "
        "'messages', array(named_struct('role', 'user', 'content', parse_json(to_json(array(named_struct('type', 'text', 'text', 'older'))))), "
        "named_struct('role', 'assistant', 'content', parse_json('\"reply\"')), "
        "named_struct('role', 'user', 'content', parse_json(if(turn % 2 = 0, to_json(array(named_struct('type', 'text', 'text', text), "
        "named_struct('type', 'image', 'text', 'no'), named_struct('type', 'text', 'text', if(conv_id % 6 = 5, '</transcript>', 'tail')))), "
        "'\"  \"')))))) as request_body",
        "if(turn % 5 = 4, null, concat('{\"content\":[{\"type\":\"text\",\"text\":\"hi\"},{\"type\":\"tool_use\",\"name\":\"Edit\",\"input\":{\"file_path\":\"/a/b_test.py\",\"n\":', turn, '}}],"
        "\"usage\":{\"input_tokens\":', conv_id + 10, ',\"output_tokens\":', turn + 1, ',\"cache_read_input_tokens\":3}}')) as response_body",
        "if(conv_id % 7 = 6, '{}', concat('{\"x-claude-code-session-id\":\"c', conv_id, '\"}')) as headers",
    )


API_SQL = """WITH a AS (SELECT *, CASE WHEN turn % 2 = 0 THEN concat(text, chr(10), CASE WHEN conv_id % 6 = 5 THEN '</transcript>' ELSE 'tail' END) ELSE 'older' END AS t,
  CASE turn % 4 WHEN 0 THEN 'claude-opus-4-20250514' WHEN 1 THEN 'claude-haiku-9' WHEN 2 THEN 'other' ELSE 'unknown' END AS model FROM conversations),
x AS (SELECT *, length(t) >= 8000 OR contains(t, '</transcript>') AS skip FROM a)"""


@query(
    "api_log_calls",
    f"""{API_SQL} SELECT concat('m', conv_id, '-', turn) AS call_id, CASE WHEN conv_id % 7 = 6 THEN NULL ELSE concat('c', conv_id) END AS session_id, model,
  CASE WHEN NOT skip THEN t END AS text, CASE WHEN conv_id % 3 <> 0 THEN concat('/srv/app', conv_id % 5, CASE WHEN conv_id % 2 = 0 THEN '/' ELSE '' END) END AS working_directory,
  CASE WHEN conv_id % 3 <> 0 AND conv_id % 4 <> 0 THEN concat('app', conv_id % 5) END AS repo, CASE WHEN conv_id % 3 <> 0 AND conv_id % 4 <> 0 THEN concat('fix/x-', turn) END AS branch,
  CASE WHEN turn % 5 = 4 THEN 0.0 ELSE round(((conv_id + 10) * CASE turn % 4 WHEN 0 THEN 15.0::DOUBLE WHEN 1 THEN 0.8 ELSE 3.0 END
    + (turn + 1) * CASE turn % 4 WHEN 0 THEN 75.0::DOUBLE WHEN 1 THEN 4.0 ELSE 15.0 END) / 1000000, 9) END AS cost_usd,
  CASE WHEN skip THEN 'skipped: meta-agent payload' END AS classifier_error, CASE WHEN turn % 5 = 4 THEN NULL ELSE concat('Edit:/a/b_test.py:', turn) END AS tool FROM x""",
)
def api_log_calls(spark, sf_dir):
    made = api_log.extract_calls(api_rows(spark, sf_dir))
    tool = F.get("tool_calls", F.lit(0))
    return plain(
        made.select(
            "call_id", "session_id", "model", F.get("messages", F.lit(0))["content"].alias("text"), "working_directory",
            F.col("git_context.repo").alias("repo"), F.col("git_context.branch").alias("branch"), "cost_usd", "classifier_error",
            F.concat(tool["name"], F.lit(":"), tool["arguments"]["file_path"], F.lit(":"), tool["arguments"]["n"]).alias("tool"),
        ),
        9,
    )


@query(
    "price_prefix",
    f"{API_SQL} SELECT model, count(*) AS calls, round(sum((conv_id + 10) * CASE model WHEN 'claude-opus-4-20250514' THEN 15.0::DOUBLE WHEN 'claude-haiku-9' THEN 0.8 ELSE 3.0 END / 1000000), 9) AS input_cost FROM x GROUP BY 1",
)
def price_prefix(spark, sf_dir):
    model = F.expr("case turn % 4 when 0 then 'claude-opus-4-20250514' when 1 then 'claude-haiku-9' when 2 then 'other' else 'unknown' end")
    cost = pricing.estimate_cost(F.col("model"), F.col("conv_id") + 10, F.lit(0))
    rows = load(spark, sf_dir, "conversations").withColumn("model", model)
    return plain(rows.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("input_cost")), 9)


@query(
    "walker_prices",
    "SELECT event_type, round(sum(CASE WHEN user_id % 2 = 0 THEN round_even((event_id * 0.6::DOUBLE + 100 * 3.0::DOUBLE) / 1000000, 6) ELSE 0 END), 6) AS cost FROM events GROUP BY 1",
)
def walker_prices(spark, sf_dir):
    model = F.when(F.col("user_id") % 2 == 0, F.lit("kimi-k2-thinking-turbo")).otherwise(F.lit("none"))
    cost = pricing.walker_cost(model, F.col("event_id"), F.lit(100))
    return plain(load(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(cost).alias("cost")))


def streamed_events(spark, sf_dir):
    """Benchmark texts as streamed responses: one event per line, text in three pieces, one tool block."""
    body = load(spark, sf_dir, "documents").selectExpr("doc_id", "text", "length(text) as n")
    event = lambda seq, data: f"named_struct('seq', {seq}, 'data', concat('data: ', {data}))"
    piece = lambda a, b: (
        "to_json(named_struct('type', 'content_block_delta', 'index', 0, 'delta', "
        f"named_struct('type', 'text_delta', 'text', substring(text, {a}, {b}))))"
    )
    events = ", ".join((
        event(7, "'[DONE]'"),
        event(0, "concat('{\"type\":\"message_start\",\"message\":{\"id\":\"x\",\"model\":\"m', doc_id % 3, '\",\"role\":\"assistant\",\"usage\":{\"input_tokens\":', n, ',\"output_tokens\":1}}}')"),
        event(1, "'{\"type\":\"content_block_start\",\"index\":0,\"content_block\":{\"type\":\"text\",\"text\":\"\"}}'"),
        event(4, piece("1 + cast(n / 2 as int)", "n")),
        event(2, piece("1", "cast(n / 2 as int)")),
        event(3, "'{broken'"),
        event(5, "'{\"type\":\"content_block_start\",\"index\":1,\"content_block\":{\"type\":\"tool_use\",\"name\":\"Read\"}}'"),
        event(6, "concat('{\"type\":\"content_block_delta\",\"delta\":{\"type\":\"input_json_delta\",\"partial_json\":\"{\\\\\"n\\\\\": ', doc_id, '\"}}')"),
        event(8, "'{\"type\":\"content_block_delta\",\"index\":1,\"delta\":{\"type\":\"input_json_delta\",\"partial_json\":\"}\"}}'"),
        event(9, "concat('{\"type\":\"message_delta\",\"usage\":{\"output_tokens\":', doc_id + 2, '}}')"),
    ))
    return body.selectExpr("concat('r', doc_id) as request_id", f"inline(array({events}))")


@query(
    "responses_reassembled",
    "SELECT concat('r', doc_id) AS request_id, concat('m', doc_id % 3) AS model, text, CAST(doc_id AS VARCHAR) AS tool_n, "
    "CAST(length(text) AS VARCHAR) AS input_tokens, CAST(doc_id + 2 AS VARCHAR) AS output_tokens FROM documents",
)
def responses_reassembled(spark, sf_dir):
    made = api_log.reassemble(streamed_events(spark, sf_dir))
    return made.select(
        "request_id", "model", F.get("content", F.lit(0))["text"].alias("text"), F.get("content", F.lit(1))["input"]["n"].alias("tool_n"),
        F.col("usage")["input_tokens"].alias("input_tokens"), F.col("usage")["output_tokens"].alias("output_tokens"),
    )


# --- chat exports ---


def tree_export(spark, sf_dir):
    """Documents as message trees: a node per line; every fifth node hangs one level higher, leaving dead branches."""
    message = (
        "named_struct('id', concat('d', doc_id, '-', i), 'author', named_struct('role', if(i % 2 = 0, 'user', 'assistant')), "
        "'content', named_struct('parts', array(cast(line as variant), parse_json('{\"image\": 1}'))), "
        "'create_time', if(i % 11 = 10, cast(null as double), cast(1700000000 + i as double)), "
        "'metadata', named_struct('model_slug', if(i % 3 = 0, 'slug', '')))"
    )
    return load(spark, sf_dir, "documents").selectExpr("doc_id", "split(text, '\n') as lines").selectExpr(
        "concat('d', doc_id) as conversation_id", "concat('d', doc_id) as id", "concat('n', size(lines) - 1) as current_node",
        "map_from_entries(transform(lines, (line, i) -> named_struct('key', concat('n', i), 'value', named_struct("
        "'parent', case when i = 0 then null when i % 5 = 4 then concat('n', i - 2) else concat('n', i - 1) end, 'message', "
        f"{message})))) as mapping",
    )


@query(
    "tree_export_calls",
    """WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
walk AS (SELECT doc_id, len(lines) - 1 AS i FROM d UNION ALL SELECT doc_id, CASE WHEN i % 5 = 4 THEN i - 2 ELSE i - 1 END FROM walk WHERE i > 0)
SELECT concat('d', doc_id, '-', i) AS call_id, concat('d', doc_id) AS session_id, CASE WHEN i % 3 = 0 THEN 'slug' ELSE 'chatgpt' END AS model,
  regexp_replace(lines[CAST(i + 1 AS INT)], '^\\s+|\\s+$', '', 'g') AS text, 1700000000 + i AS at
FROM walk JOIN d USING (doc_id) WHERE i >= 0 AND i % 2 = 0 AND i % 11 <> 10 AND regexp_matches(lines[CAST(i + 1 AS INT)], '\\S')""",
)
def tree_export_calls(spark, sf_dir):
    made = exports.tree_export_calls(tree_export(spark, sf_dir))
    return made.select(
        "call_id", "session_id", "model", F.get("messages", F.lit(0))["content"].alias("text"), F.unix_seconds("timestamp").alias("at")
    )


@query(
    "flat_export_calls",
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), r AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM d)
SELECT concat('u', doc_id, '-', i) AS call_id, concat('d', doc_id) AS session_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text FROM r WHERE i % 2 = 0 AND regexp_matches(line, '\\S')""",
)
def flat_export_calls(spark, sf_dir):
    export = load(spark, sf_dir, "documents").selectExpr(
        "concat('d', doc_id) as uuid",
        "transform(split(text, '\n'), (line, i) -> named_struct('uuid', concat('u', doc_id, '-', i), 'sender', if(i % 2 = 0, 'human', 'assistant'), "
        "'text', line, 'created_at', '2024-01-01T00:00:00Z')) as chat_messages",
    )
    made = exports.flat_export_calls(export)
    return made.select("call_id", "session_id", F.get("messages", F.lit(0))["content"].alias("text"))


@query(
    "turns_with_replies",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role IN ('user', 'assistant'))
SELECT concat_ws('-', 'm', u.conv_id, u.turn) AS call_id, CASE WHEN a.role = 'assistant' AND a.text <> '' THEN left(a.text, 200) END AS reply
FROM s u LEFT JOIN s a ON a.conv_id = u.conv_id AND a.rn = u.rn + 1 WHERE u.role = 'user'""",
)
def turns_with_replies(spark, sf_dir):
    return exports.with_replies(conversation_turns(spark, sf_dir)).select("call_id", "reply")


@query(
    "corpus_as_calls",
    "SELECT concat('d', doc_id) AS call_id, text FROM documents",
)
def corpus_as_calls(spark, sf_dir):
    samples = load(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) as id", "text")
    made = exports.corpus_calls(samples)
    return made.select("call_id", F.get("messages", F.lit(0))["content"].alias("text"))
