"""Analytics over page paths and classified events, and the streaming jobs run to completion."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from facetledger.operators import corpus as cp
from facetledger.operators import resolve as rs
from facetledger.operators import sessions as ss
from facetledger.operators.scan import CHUNK, ROW, stage_ranges
from facetledger.operators.classify import activity_rules, context_rules, domain_keywords, keyword_tagger, project_workdir
from facetledger.plans.cost_queries import SPEND_CTE
from facetledger.plans.label_queries import ACTIVITY_SQL, CALLS_CTE, DOMAIN_SQL, TAGS_SQL
from facetledger.plans.registry import plain, query
from facetledger.plans.session_queries import CLASSIFIED, CONTEXT_SQL, DECAY_SQL, ORDERED, RULES, arc_calls, calls, updates_sql
from facetledger.plans.source_queries import API_SQL, api_rows
from facetledger.runtime import checkpoint_dir, stage, use_utc
from facetledger.sources import log_index, spend_log
from facetledger.sources.tables import SPEND_TIME, calls_from_events, load, spend_from_items, spend_rows
from facetledger.streaming import online

PAGES_CTE = """
WITH b AS (SELECT page_id, concat('h', page_id % 40) AS session_id, concat('p', page_id) AS call_id,
    regexp_replace(regexp_extract(url, '^https?://(?:[a-z]+\\.)?[a-z]+\\.example\\.([a-z]+/[a-z]+/[0-9]+)', 1), '[0-9]$', '') AS path FROM pages),
m AS (SELECT *, page_id % 9 = 0 AS nothing, page_id % 4 AS r,
  list_filter([CASE WHEN page_id % 9 <> 0 AND path <> '' THEN {'path': path, 'confidence': CAST(40 + page_id % 60 AS DOUBLE) / 100.0::DOUBLE} END,
    CASE WHEN page_id % 9 <> 0 AND page_id % 4 = 1 THEN {'path': 'net/en', 'confidence': 0.6::DOUBLE} END,
    CASE WHEN page_id % 9 <> 0 AND page_id % 8 = 1 THEN {'path': 'solo', 'confidence': 0.96::DOUBLE} END], lambda x: x IS NOT NULL) AS paths FROM b),
e AS (SELECT session_id, call_id, p.path AS path, p.confidence AS confidence FROM (SELECT session_id, call_id, unnest(paths) AS p FROM m))
"""


def messages(spark, sf_dir):
    path = F.regexp_replace(
        F.regexp_extract("url", r"^https?://(?:[a-z]+\.)?[a-z]+\.example\.([a-z]+/[a-z]+/[0-9]+)", 1), "[0-9]$", ""
    )
    rows = load(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    entry = lambda when, p, c: f"if(page_id % 9 <> 0 and {when}, named_struct('path', {p}, 'confidence', {c}), null)"
    paths = ", ".join((
        entry("path <> ''", "path", "cast(40 + page_id % 60 as double) / 100.0D"), entry("page_id % 4 = 1", "'net/en'", "0.6D"),
        entry("page_id % 8 = 1", "'solo'", "0.96D"),
    ))
    return rows.selectExpr(
        "concat('h', page_id % 40) as session_id", "concat('p', page_id) as call_id", f"filter(array({paths}), p -> p is not null) as paths",
        "page_id % 3 = 0 as inherited", "cast(page_id % 7 as double) as cost_usd", "page_id % 5 as model_calls", "cast(page_id % 11 as double) as elapsed_sec",
    )


@query(
    "path_coverage",
    f"{PAGES_CTE} SELECT count(*) AS messages, count(*) FILTER (WHERE len(paths) > 0) AS matched, count(*) FILTER (WHERE len(paths) = 0) AS unmatched, "
    "round(count(*) FILTER (WHERE len(paths) > 0) / count(*) * 100, 6) AS matched_pct FROM m",
)
def path_coverage(spark, sf_dir):
    return plain(cp.coverage(messages(spark, sf_dir)))


@query(
    "confidence_histogram",
    f"{PAGES_CTE} SELECT CASE WHEN confidence >= 0.95 THEN '>=0.95' WHEN confidence >= 0.85 THEN '0.85-0.94' WHEN confidence >= 0.70 THEN '0.70-0.84' WHEN confidence >= 0.50 THEN '0.50-0.69' "
    "ELSE '<0.50' END AS bucket, count(*) AS n, round(avg(confidence), 6) AS mean, round(count(*) / (SELECT count(*) FROM e) * 100.0, 6) AS pct FROM e GROUP BY 1",
)
def confidence_histogram(spark, sf_dir):
    return plain(cp.confidence_histogram(messages(spark, sf_dir)))


@query(
    "depth_distribution",
    f"{PAGES_CTE} SELECT CAST(len(string_split(path, '/')) AS INT) AS depth, count(*) AS n, round(count(*) / (SELECT count(*) FROM e) * 100.0, 6) AS pct FROM e GROUP BY 1",
)
def depth_distribution(spark, sf_dir):
    return plain(cp.depth_distribution(messages(spark, sf_dir)))


@query(
    "category_shares",
    f"{PAGES_CTE} SELECT split_part(path, '/', 1) AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM e) * 100.0, 6) AS pct FROM e GROUP BY 1",
)
def category_shares(spark, sf_dir):
    return plain(cp.category_shares(messages(spark, sf_dir)))


@query(
    "second_level_shares",
    f"{PAGES_CTE} SELECT concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) AS category, count(*) AS n, "
    "round(count(*) / (SELECT count(*) FROM e) * 100.0, 6) AS pct FROM e WHERE path LIKE '%/%' GROUP BY 1",
)
def second_level_shares(spark, sf_dir):
    return plain(cp.category_shares(messages(spark, sf_dir), 2))


@query("common_paths", f"{PAGES_CTE} SELECT path, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, path LIMIT 30")
def common_paths(spark, sf_dir):
    return cp.common_paths(messages(spark, sf_dir))


@query(
    "path_long_tail",
    f"{PAGES_CTE} SELECT count(*) AS paths, count(*) FILTER (WHERE n = 1) AS once, round(count(*) FILTER (WHERE n = 1) / count(*) * 100, 6) AS once_pct FROM (SELECT path, count(*) AS n FROM e GROUP BY 1)",
)
def path_long_tail(spark, sf_dir):
    return plain(cp.long_tail(messages(spark, sf_dir)))


@query(
    "session_consistency",
    f"{PAGES_CTE}, s AS (SELECT m.session_id, count(DISTINCT m.call_id) AS n, count(DISTINCT split_part(e.path, '/', 1)) AS c FROM m LEFT JOIN e ON e.call_id = m.call_id GROUP BY 1) "
    "SELECT count(*) AS sessions, count(*) FILTER (WHERE c <= 1) AS consistent, count(*) FILTER (WHERE c > 1) AS inconsistent FROM s WHERE n >= 2",
)
def session_consistency(spark, sf_dir):
    return cp.session_consistency(messages(spark, sf_dir))


@query(
    "run_costs",
    "SELECT count(*) AS messages, round(sum(page_id % 7), 6)::DOUBLE AS total_cost_usd, CAST(sum(page_id % 5) AS BIGINT) AS total_model_calls, sum(page_id % 11)::DOUBLE AS total_elapsed_sec, "
    "round(sum(page_id % 7) / count(*), 6) AS avg_cost_usd, round(sum(page_id % 5) / count(*), 6) AS avg_model_calls, round(sum(page_id % 11) / count(*), 6) AS avg_elapsed_sec FROM pages",
)
def run_costs(spark, sf_dir):
    return plain(cp.run_costs(messages(spark, sf_dir)))


@query(
    "quality_issues",
    f"{PAGES_CTE} SELECT (SELECT count(*) FROM e WHERE confidence < 0.7) AS low_confidence, (SELECT count(*) FROM e WHERE len(string_split(path, '/')) <= 2) AS shallow, "
    "count(*) FILTER (WHERE len(paths) = 0 AND page_id % 3 = 0) AS inherited_only, count(*) FILTER (WHERE len(paths) >= 3) AS multi_path FROM m",
)
def quality_issues(spark, sf_dir):
    return cp.quality_issues(messages(spark, sf_dir))


def labelled(spark, sf_dir):
    return rs.classify(calls(spark, sf_dir), {"context": context_rules, "domain": domain_keywords, "tags": keyword_tagger})


INHERITED_SQL = "source LIKE 'session-inherited-from-%'"


# Followers with what they take from their anchor: every facet of the anchor's whose own verdict is not declared.
REVISED = f"""{CLASSIFIED}, near AS (SELECT *, coalesce(
  last_value(CASE WHEN anchor THEN call_id END IGNORE NULLS) OVER (PARTITION BY arc_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING),
  first_value(CASE WHEN anchor THEN call_id END IGNORE NULLS) OVER (PARTITION BY arc_id ORDER BY ts, call_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS anchor_id FROM arcs),
most AS (SELECT call_id, facet, max(confidence) AS most FROM final GROUP BY 1, 2),
taken AS (SELECT near.call_id, near.anchor_id, b.facet FROM near JOIN most b ON b.call_id = near.anchor_id LEFT JOIN most w ON w.call_id = near.call_id AND w.facet = b.facet
  WHERE NOT near.anchor AND near.session_id IS NOT NULL AND coalesce(w.most, 0) < 0.99),
after AS (SELECT call_id, facet, value, confidence, source FROM final ANTI JOIN taken USING (call_id, facet)
  UNION ALL SELECT t.call_id, f.facet, f.value, f.confidence, concat('anchor-inherited-from-', t.anchor_id) FROM taken t JOIN final f ON f.call_id = t.anchor_id AND f.facet = t.facet)"""


@query(
    "inheritance_counts",
    f"{REVISED} SELECT (SELECT count(*) FROM after WHERE {INHERITED_SQL}) AS session_inherited, (SELECT count(*) FROM after WHERE source LIKE 'anchor-inherited-from-%') AS anchor_inherited, "
    f"(SELECT count(DISTINCT call_id) FROM after WHERE {INHERITED_SQL} OR source LIKE 'anchor-inherited-from-%') AS calls_with_any, (SELECT count(*) FROM calls) AS calls",
)
def inheritance_counts(spark, sf_dir):
    arcs = ss.classify_sessions(arc_calls(spark, sf_dir), rules=RULES).withColumn("is_anchor", ss.is_anchor(RULES.anchor_min_chars))
    marked = stage_ranges(arcs.select("session_id", "arc_id", "call_id", "is_anchor", "classifications", CHUNK, ROW))
    return cp.inheritance(ss.revise_by_anchor(marked, RULES).withColumn("classifications", F.col("_revised")))


LABELLED = f"{TAGS_SQL}{DOMAIN_SQL[len(CALLS_CTE):]}"
CONTEXT_CONFIDENCE = "CASE WHEN workdir LIKE '/tmp%' THEN 0.5::DOUBLE ELSE 0.85 END"
BUCKET = "CASE WHEN c >= 0.95 THEN '>=0.95' WHEN c >= 0.85 THEN '0.85-0.94' WHEN c >= 0.7 THEN '0.70-0.84' WHEN c >= 0.5 THEN '0.50-0.69' ELSE '<0.50' END"
LONG_LABELS = (
    f"{LABELLED}, l AS (SELECT call_id, 'context' AS facet, {CONTEXT_SQL} AS value, {CONTEXT_CONFIDENCE} AS c FROM calls "
    "UNION ALL SELECT call_id, 'domain', domain, CASE WHEN n = 1 THEN 0.6::DOUBLE ELSE 0.8 END FROM r WHERE rk = 1 AND n > 0 UNION ALL SELECT call_id, 'tags', value, confidence FROM tags)"
)


@query(
    "facet_statistics",
    f"{CLASSIFIED}, rn AS (SELECT call_id, s, ts, row_number() OVER (PARTITION BY s ORDER BY ts, call_id) AS rn FROM o WHERE session_id IS NOT NULL), "
    "v AS (SELECT rn.*, facet, value, confidence AS conf, source AS src FROM final JOIN rn USING (call_id) WHERE facet IN ('context', 'domain', 'activity')), "
    f"{updates_sql(0.9)}, l AS (SELECT f.call_id, f.facet, coalesce(u.nv, f.value) AS value, CASE WHEN u.nid IS NULL THEN f.confidence ELSE 0.8 END AS c, "
    "CASE WHEN u.nid IS NULL THEN f.source ELSE concat('back-propagated-from-', u.nid) END AS source FROM final f LEFT JOIN upd u ON u.call_id = f.call_id AND u.facet = f.facet) "
    "SELECT facet, count(DISTINCT call_id) AS calls, count(*) AS verdicts, count(DISTINCT value) AS distinct_values, round(avg(c), 6) AS mean_confidence, "
    f"count(*) FILTER (WHERE {INHERITED_SQL}) AS inherited, count(*) FILTER (WHERE source LIKE 'back-propagated-from-%') AS back_propagated FROM l GROUP BY 1",
)
def facet_statistics(spark, sf_dir):
    rows = stage_ranges(ss.classify_sessions(calls(spark, sf_dir), rules=RULES).select("session_id", "call_id", "timestamp", "classifications", CHUNK, ROW))
    spread = ss.back_propagate(rows, RULES).select("call_id", F.col("propagated").alias("classifications"))
    return plain(cp.facet_statistics(spread.unionByName(rows.filter("session_id is null").select("call_id", "classifications"))))


@query("facet_value_counts", f"{LONG_LABELS} SELECT facet, value, {BUCKET} AS bucket, count(*) AS n FROM l GROUP BY ALL")
def facet_value_counts(spark, sf_dir):
    return cp.facet_values(labelled(spark, sf_dir))


@query(
    "arc_cost_shares",
    f"{ORDERED}, z AS (SELECT arc_id, count(*) AS n FROM arcs GROUP BY 1) SELECT call_id, arc_id, n AS arc_size, round_even(n * n / n::DOUBLE, 2) AS model_calls, "
    "round_even(7.0::DOUBLE / n, 4) AS cost_usd, round_even(100.0::DOUBLE / n, 2) AS elapsed_sec FROM arcs JOIN z USING (arc_id)",
)
def arc_cost_shares(spark, sf_dir):
    rows = arc_calls(spark, sf_dir)
    n = F.count(F.lit(1))
    costs = rows.groupBy("arc_id").agg((n * n).alias("model_calls"), F.lit(7.0).alias("cost_usd"), F.lit(100.0).alias("elapsed_sec"))
    return plain(cp.arc_shares(rows, costs))


@query(
    "dominant_topics",
    f"{TAGS_SQL}, c AS (SELECT session_id, tags.value AS topic, count(*) AS n FROM tags JOIN calls ON calls.call_id = tags.call_id GROUP BY ALL) "
    "SELECT session_id, arg_min(topic, (-n, topic)) AS topic, max(n) AS n, CAST(sum(n) AS BIGINT) AS verdicts FROM c GROUP BY 1",
)
def dominant_topics(spark, sf_dir):
    return cp.dominant_topics(labelled(spark, sf_dir))


@query("longest_sessions", f"{CALLS_CTE} SELECT session_id, count(*) AS calls FROM calls WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY calls DESC, session_id LIMIT 20")
def longest_sessions(spark, sf_dir):
    return cp.longest_sessions(calls(spark, sf_dir))


@query(
    "hour_weekday",
    "SELECT 'hour' AS unit, CAST(hour(ts) AS VARCHAR) AS value, count(*) AS calls FROM events GROUP BY 2 UNION ALL SELECT 'weekday', CAST(isodow(ts) - 1 AS VARCHAR), count(*) FROM events GROUP BY 2 "
    "UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), count(*) FROM events GROUP BY 2",
)
def hour_weekday(spark, sf_dir):
    return cp.volume(calls(spark, sf_dir))


@query(
    "session_flags",
    f"{TAGS_SQL}, f AS (SELECT calls.session_id, bool_or(coalesce(tags.value = 'food', FALSE)) AS flagged, bool_or({CONTEXT_SQL} = 'business') AS b, bool_or({CONTEXT_SQL} = 'personal') AS p "
    "FROM calls LEFT JOIN tags ON tags.call_id = calls.call_id WHERE calls.session_id IS NOT NULL GROUP BY 1) SELECT session_id, flagged, b AND p AS mixed FROM f WHERE flagged OR (b AND p)",
)
def session_flags(spark, sf_dir):
    return cp.session_flags(labelled(spark, sf_dir), "food")


# --- streams, run over everything that is there ---


def stream_calls(spark, sf_dir):
    """Events as a stream: the same projection as the batch, over a streaming scan."""
    use_utc(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return calls_from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def run_stream(spark, stream):
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    online.write_until_done(stream, f"{base}/out", f"{base}/log")
    return spark.read.parquet(f"{base}/out")


# Without a delay the watermark reaches the last call, so that a run over all that is there releases every call.
NO_DELAY = "0 seconds"


@query("stream_labels")
def stream_labels(spark, sf_dir):
    records = run_stream(spark, online.label_sessions(stream_calls(spark, sf_dir), RULES, NO_DELAY))
    return plain(records)


@query(
    "stream_verdicts",
    f"{CLASSIFIED} SELECT call_id, facet, value, round(confidence, 6) AS confidence, source FROM final JOIN walk USING (call_id)",
)
def stream_verdicts(spark, sf_dir):
    records = run_stream(spark, online.label_sessions(stream_calls(spark, sf_dir), RULES, NO_DELAY))
    return plain(records.filter("kind = 'verdict'").select("call_id", "facet", "value", "confidence", "source"))


def streamed_states(spark, sf_dir):
    own = stream_calls(spark, sf_dir).filter("session_id is not null")
    chosen = {"context": context_rules, "domain": domain_keywords, "activity": activity_rules, "project": project_workdir, "tags": keyword_tagger}
    return run_stream(spark, online.session_state(rs.classify(own, chosen), NO_DELAY, 366 * 24 * 60))


@query(
    "stream_session_state",
    f"{ORDERED}{DOMAIN_SQL[len(CALLS_CTE):]}, acts AS (SELECT call_id, {ACTIVITY_SQL} AS activity FROM calls) SELECT session_id, call_id, round(CAST(sum(round(value / 100.0, 6)::DECIMAL(18,6)) OVER w AS DOUBLE), 6) AS total_cost_usd, "
    f"count(*) OVER w AS call_count, CASE WHEN {CONTEXT_SQL} <> 'unknown' THEN {CONTEXT_SQL} END AS context, CASE WHEN r.n > 0 THEN r.domain END AS domain, nullif(activity, 'unknown') AS activity, "
    "CASE uid % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'y2024' ELSE split_part(workdir, '/', 3) END AS project "
    "FROM o JOIN r USING (call_id) JOIN acts USING (call_id) WHERE rk = 1 AND session_id IS NOT NULL WINDOW w AS (PARTITION BY s ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING)",
)
def stream_session_state(spark, sf_dir):
    states = streamed_states(spark, sf_dir).withColumn("project", F.array_join("project", ","))
    return plain(states.select("session_id", "call_id", "total_cost_usd", "call_count", "context", "domain", "activity", "project"))


@query("stream_tag_states", DECAY_SQL)
def stream_tag_states(spark, sf_dir):
    return plain(streamed_states(spark, sf_dir).select("session_id", "call_id", F.inline_outer("tags")))


@query(
    "stream_rollup",
    f"{CALLS_CTE} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, concat('model-', uid % 3) AS model, count(*) AS calls, "
    "round(CAST(sum(round(value / 100.0, 6)::DECIMAL(18,6)) AS DOUBLE), 6) AS cost_usd FROM calls GROUP BY ALL",
)
def stream_rollup(spark, sf_dir):
    base = f"{checkpoint_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"
    live = online.rollup(stream_calls(spark, sf_dir), "1 day", "1 hour", "model").withColumn("day", F.to_date("window_start"))
    online.upsert_until_done(live, f"{base}/out", f"{base}/log", ["window_start", "model"], "day")
    out = spark.read.parquet(f"{base}/out").drop("day", "_batch")
    return plain(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


@query(
    "logged_calls",
    f"{API_SQL} SELECT concat('m', conv_id, '-', turn) AS call_id, concat('c', conv_id) AS session_id, model, skip AS failed, "
    "round(CASE WHEN turn % 5 = 4 THEN 0.0 ELSE round_even(((conv_id + 10) * CASE turn % 4 WHEN 0 THEN 15.0::DOUBLE WHEN 1 THEN 0.8 ELSE 3.0 END "
    "+ (turn + 1) * CASE turn % 4 WHEN 0 THEN 75.0::DOUBLE WHEN 1 THEN 4.0 ELSE 15.0 END) / 1000000, 6) END, 6) AS cost_usd, "
    "CASE WHEN skip THEN '' ELSE left(t, 30) END AS prompt_prefix FROM x WHERE conv_id % 7 <> 6",
)
def logged_calls(spark, sf_dir):
    rows = online.logged_calls(api_rows(spark, sf_dir), {"context": context_rules}, 30)
    return plain(rows.select("call_id", "session_id", "model", F.col("facets").isNull().alias("failed"), "cost_usd", "prompt_prefix"))


@query(
    "flat_labels",
    f"{SPEND_CTE} SELECT call_id, concat('auto:tags:', unnest(tags)) AS label FROM spend UNION ALL SELECT call_id, concat('auto:project:', unnest(projects)) FROM spend "
    "UNION ALL SELECT call_id, concat('auto:domain:', domain) FROM spend WHERE domain NOT LIKE '\\_%' ESCAPE '\\' UNION ALL SELECT call_id, concat('auto:activity:', activity) FROM spend "
    "WHERE activity NOT LIKE '\\_%' ESCAPE '\\' UNION ALL SELECT call_id, concat('auto:context:', context) FROM spend WHERE context NOT LIKE '\\_%' ESCAPE '\\'",
)
def flat_labels(spark, sf_dir):
    return online.flat_tags(spend_rows(spark, sf_dir)).select("call_id", F.explode("labels").alias("label"))


@query(
    "retained_rows",
    f"{SPEND_CTE} SELECT local_date, count(*) AS calls, '' AS prompt_prefix FROM spend WHERE local_date >= DATE '1999-06-01' GROUP BY 1",
)
def retained_rows(spark, sf_dir):
    kept = online.scrub_prompts(online.retain(spend_rows(spark, sf_dir), date(1999, 6, 1)))
    return kept.groupBy(F.to_date("timestamp").alias("local_date"), "prompt_prefix").agg(F.count(F.lit(1)).alias("calls"))


# --- the spend log, written and read back ---


def written_log(spark, sf_dir) -> str:
    """All spend rows as a log of daily folders, in a folder named by the table's files, times and sizes: it is written
    again when these are others, or when an earlier writing did not end."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/lineitem.parquet").select("path", "modificationTime", "length")
    mark = files.agg(F.sha1(F.to_json(F.array_sort(F.collect_list(F.struct("*")))))).first()[0]  # of one table's files
    folder = f"{checkpoint_dir(spark).rstrip('/')}/log-{mark}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        items = load(spark, sf_dir, "lineitem").withColumn("utc_date", F.to_date(F.expr(SPEND_TIME)))
        spend_log.append_daily(spend_from_items(spend_log.by_day(items)), folder, "overwrite")  # items are moved, not rows
    return folder


LOG_SUMS = "count(*) AS calls, round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd, sum(len(tags)) AS n_tags"


def log_sums(rows, *by):
    return plain(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"), F.sum(F.size(F.coalesce("facets.tags", F.array()))).alias("n_tags")))


RAW_TAGS = (
    "list_filter([CASE WHEN l_linenumber <> 7 AND l_quantity % 4 <> 0 THEN 1 END, CASE WHEN l_linenumber <> 7 AND l_linenumber % 2 = 1 THEN 1 END], lambda t: t IS NOT NULL) AS tags"
)


@query("log_round_trip", f"{SPEND_CTE}, w AS (SELECT local_date, cost_usd, {RAW_TAGS} FROM spend) SELECT strftime(local_date, '%Y-%m') AS month, {LOG_SUMS} FROM w GROUP BY 1")
def log_round_trip(spark, sf_dir):
    return log_sums(spend_log.load_spend(spark, written_log(spark, sf_dir)), F.date_format("timestamp", "yyyy-MM").alias("month"))


@query(
    "log_date_range",
    f"{SPEND_CTE}, w AS (SELECT local_date, cost_usd, {RAW_TAGS} FROM spend WHERE local_date BETWEEN DATE '1996-02-10' AND DATE '1996-03-20') "
    f"SELECT strftime(local_date, '%Y-%m-%d') AS day, {LOG_SUMS} FROM w GROUP BY 1",
)
def log_date_range(spark, sf_dir):
    index = log_index.refresh(spark, written_log(spark, sf_dir))
    rows = spend_log.kept_rows(log_index.tagged(spark, index, date(1996, 2, 10), date(1996, 3, 20)))
    return log_sums(rows, F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


@query("compacted_months", f"{SPEND_CTE}, w AS (SELECT local_date, cost_usd, {RAW_TAGS} FROM spend) SELECT strftime(local_date, '%Y-%m') AS month, {LOG_SUMS} FROM w GROUP BY 1")
def compacted_months(spark, sf_dir):
    target = f"{checkpoint_dir(spark).rstrip('/')}/months-{uuid.uuid4().hex}"
    online.compact(spark, written_log(spark, sf_dir), target)
    months = spark.read.parquet(target)
    return log_sums(months, F.date_format(F.to_date(F.concat(F.col("month").cast("string"), F.lit("-01"))), "yyyy-MM").alias("month"))


@query("spend_stream", f"{SPEND_CTE}, w AS (SELECT model, cost_usd, {RAW_TAGS} FROM spend) SELECT model, {LOG_SUMS} FROM w GROUP BY 1")
def spend_stream(spark, sf_dir):
    tagged = online.read_spend_stream(spark, written_log(spark, sf_dir))
    return log_sums(run_stream(spark, spend_log.kept_rows(tagged)), "model")


@query(
    "log_load_stats",
    f"{SPEND_CTE} SELECT count(*) AS rows_seen, count(*) FILTER (WHERE local_date BETWEEN DATE '1996-02-10' AND DATE '1996-03-20') AS rows_kept, "
    "count(*) FILTER (WHERE local_date NOT BETWEEN DATE '1996-02-10' AND DATE '1996-03-20') AS rows_skipped_date, "
    "count(*) FILTER (WHERE local_date BETWEEN DATE '1996-02-10' AND DATE '1996-03-20' AND classifier_failed) AS rows_classifier_error FROM spend",
)
def log_load_stats(spark, sf_dir):
    """Counters of the whole log beside the rows of a range, from the index."""
    index = log_index.refresh(spark, written_log(spark, sf_dir))
    rows = log_index.tagged(spark, index, date(1996, 2, 10), date(1996, 3, 20))
    return log_index.load_stats(index, rows).select("rows_seen", "rows_kept", "rows_skipped_date", "rows_classifier_error")


@query("file_fingerprint", f"{SPEND_CTE} SELECT strftime(local_date, '%Y-%m-%d') AS day, TRUE AS has_files, TRUE AS size_is_that_of_the_lines, TRUE AS times_are_past FROM spend GROUP BY 1")
def file_fingerprint(spark, sf_dir):
    """Files by day: the sizes that they state are those of the lines in them, and they are not of the future."""
    folder = written_log(spark, sf_dir)
    day = lambda path: F.regexp_extract(path, spend_log.DAY_IN_PATH, 1).alias("day")
    sized = spend_log.fingerprint(spark, folder).filter("length > 0").join(spend_log.line_bytes(spark, folder), "path")
    files = sized.groupBy(day("path")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("modificationTime").alias("latest")
    )
    lines = spend_log.read_lines(spark, folder).groupBy(day("file")).agg(F.sum(F.octet_length("line") + 1).alias("in_lines"))
    return files.join(lines, "day").select(
        "day", (F.col("files") > 0).alias("has_files"), (F.col("bytes") == F.col("in_lines")).alias("size_is_that_of_the_lines"), (F.col("latest") <= F.current_timestamp()).alias("times_are_past")
    )
