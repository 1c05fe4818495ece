"""Cost attribution over line items read as spend rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from facetledger.functions import display
from facetledger.operators import attribution as at
from facetledger.plans.registry import plain, query
from facetledger.sources.tables import SPEND_DOMAINS, TAG_NAMES, spend_rows
from facetledger.vocab import ACTIVITY_VALUES


def sql_list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


SPEND_CTE = f"""
WITH raw AS (
  SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS call_id,
    CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE concat('s', l_orderkey) END AS session_id,
    l_shipdate + to_minutes(CAST((l_partkey * 7 + l_suppkey * 13) % 1440 AS BIGINT)) AS ts,
    concat('model-', l_linestatus, '-', l_suppkey % 3) AS model,
    concat('agent-', l_returnflag) AS agent,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('v', l_linenumber % 3) END AS pipeline_version,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,6)) AS cost_usd,
    CAST(l_quantity AS BIGINT) * 100 AS tokens_input,
    CAST(l_quantity AS BIGINT) * 10 AS tokens_output,
    CAST(round(l_quantity * l_discount * 1000) AS BIGINT) AS tokens_cache_read,
    l_linenumber = 7 AND l_partkey % 5 <> 0 AS classifier_failed,
    CASE WHEN l_linenumber = 7 AND l_partkey % 5 <> 0 THEN '_unknown'
         WHEN l_linenumber = 7 THEN '_no_classification' END AS missing,
    concat('Order ', l_orderkey, ' part ', l_partkey) AS prompt_prefix
  FROM lineitem
), spend AS (
  SELECT *, CAST(ts AS DATE) AS local_date, tokens_input + tokens_cache_read AS total_input_tokens,
    CASE WHEN classifier_failed THEN 'ValueError: bad input' END AS classifier_error,
    coalesce(missing, CASE WHEN l_partkey % 17 = 0 THEN '_unset'
      ELSE ['business','personal','unknown'][CAST(l_suppkey % 3 + 1 AS INT)] END) AS context,
    coalesce(missing, {sql_list(SPEND_DOMAINS)}[CAST(l_partkey % 5 + 1 AS INT)]) AS domain,
    coalesce(missing, {sql_list(ACTIVITY_VALUES)}[CAST(l_partkey % 11 + 1 AS INT)]) AS activity,
    CASE WHEN missing IS NOT NULL THEN []::VARCHAR[] ELSE
      list_distinct(list_filter([CASE WHEN l_suppkey % 9 <> 0 THEN concat('proj-', l_suppkey % 40) END,
        CASE WHEN l_quantity > 25 THEN concat('proj-', l_partkey % 40) END], lambda p: p IS NOT NULL)) END AS projects,
    CASE WHEN missing IS NOT NULL THEN []::VARCHAR[] ELSE
      list_distinct(list_filter([CASE WHEN l_quantity % 4 <> 0 THEN {sql_list(TAG_NAMES)}[CAST(l_partkey % 10 + 1 AS INT)] END,
        CASE WHEN l_linenumber % 2 = 1 THEN {sql_list(TAG_NAMES)}[CAST(l_suppkey % 10 + 1 AS INT)] END],
        lambda t: t IS NOT NULL)) END AS tags,
    coalesce(missing, CASE WHEN l_suppkey % 9 <> 0 THEN concat('proj-', l_suppkey % 40)
      WHEN l_quantity > 25 THEN concat('proj-', l_partkey % 40) END, '_untagged') AS primary_project,
    coalesce(missing, CASE WHEN l_quantity % 4 <> 0 THEN {sql_list(TAG_NAMES)}[CAST(l_partkey % 10 + 1 AS INT)]
      WHEN l_linenumber % 2 = 1 THEN {sql_list(TAG_NAMES)}[CAST(l_suppkey % 10 + 1 AS INT)] END, '_untagged') AS primary_tag
  FROM raw
)
"""

METRICS = """
  calls, round(CAST(cost AS DOUBLE), 6) AS cost_usd, CAST(rd AS BIGINT) AS cache_read_tokens,
  CAST(tot AS BIGINT) AS total_input_tokens,
  round(CAST(cost AS DOUBLE) / calls, 6) AS dollar_per_call,
  round(CAST(cost AS DOUBLE) / (SELECT CAST(sum(cost_usd) AS DOUBLE) FROM spend) * 100.0, 6) AS pct_of_period,
  round(CASE WHEN tot = 0 THEN 0.0 ELSE CAST(rd AS DOUBLE) / CAST(tot AS DOUBLE) END * 100.0, 6) AS cache_hit_pct,
  CAST(round_even(CAST(tot AS DOUBLE) / calls, 0) AS BIGINT) AS avg_input_tokens
"""
SUMS = "count(*) AS calls, sum(cost_usd) AS cost, sum(tokens_cache_read) AS rd, sum(total_input_tokens) AS tot"


def breakdown_sql(column: str) -> str:
    return f"{SPEND_CTE} SELECT value, {METRICS} FROM (SELECT {column} AS value, {SUMS} FROM spend GROUP BY 1)"


def any_sql(column: str) -> str:
    return (
        f"{SPEND_CTE} SELECT value, {METRICS} FROM (SELECT value, {SUMS} FROM "
        f"(SELECT unnest({column}) AS value, cost_usd, tokens_cache_read, total_input_tokens FROM spend) GROUP BY 1)"
    )


def spend(spark, sf_dir):
    return at.flatten_spend(spend_rows(spark, sf_dir))


def register_breakdown(name: str, column: str) -> None:
    @query(name, breakdown_sql(column))
    def run(spark, sf_dir):
        return plain(at.breakdown(spend(spark, sf_dir), column))


for _name, _column in {
    "primary_lens_project": "primary_project",
    "primary_lens_tags": "primary_tag",
    "breakdown_context": "context",
    "breakdown_domain": "domain",
    "breakdown_activity": "activity",
    "breakdown_agent": "agent",
    "breakdown_model": "model",
}.items():
    register_breakdown(_name, _column)


@query("any_lens_tags", any_sql("tags"))
def any_lens_tags(spark, sf_dir):
    return plain(at.any_lens(spend(spark, sf_dir), "tags"))


@query("any_lens_project", any_sql("projects"))
def any_lens_project(spark, sf_dir):
    return plain(at.any_lens(spend(spark, sf_dir), "projects"))


PIVOT = (
    f"{SPEND_CTE}, pairs AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS facet, {c} AS value, 'primary' AS lens, cost_usd, tokens_cache_read, tokens_input FROM spend"
        for f, c in (("context", "context"), ("domain", "domain"), ("activity", "activity"),
                     ("project", "primary_project"), ("tags", "primary_tag"))
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{f}', {f}, 'any', cost_usd, tokens_cache_read, tokens_input FROM spend "
        f"WHERE {f} NOT IN ('_unknown','_no_classification','_unset')"
        for f in ("context", "domain", "activity")
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{f}', unnest({c}), 'any', cost_usd, tokens_cache_read, tokens_input FROM spend"
        for f, c in (("project", "projects"), ("tags", "tags"))
    )
    + "), buckets AS (SELECT facet, value, lens, count(*) AS calls, sum(cost_usd) AS cost, "
    "CAST(sum(tokens_cache_read) AS BIGINT) AS cache_read_tokens, CAST(sum(tokens_input) AS BIGINT) AS input_tokens "
    "FROM pairs GROUP BY ALL) "
)
PIVOT_OUT = "facet, value, lens, calls, round(CAST(cost AS DOUBLE), 6) AS cost_usd, cache_read_tokens, input_tokens"


@query("csv_pivot_all", f"{PIVOT} SELECT {PIVOT_OUT} FROM buckets")
def csv_pivot_all(spark, sf_dir):
    return plain(at.pivot_all(spend_rows(spark, sf_dir)))


@query(
    "topn_per_facet",
    f"{PIVOT} SELECT {PIVOT_OUT}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY facet "
    "ORDER BY cost DESC, value) AS INT) AS rank FROM buckets WHERE lens = 'primary') WHERE rank <= 5",
)
def topn_per_facet(spark, sf_dir):
    return plain(at.top_per_facet(spend_rows(spark, sf_dir), top=5))


@query(
    "top_buckets_project",
    f"{SPEND_CTE} SELECT value, {METRICS} FROM (SELECT primary_project AS value, {SUMS} FROM spend GROUP BY 1) "
    "ORDER BY cost DESC, value NULLS FIRST LIMIT 20",
)
def top_buckets_project(spark, sf_dir):
    return plain(at.top_buckets(at.breakdown(spend(spark, sf_dir), "primary_project")))


@query(
    "diagnostic_panel_report",
    f"{SPEND_CTE} SELECT value, calls, round(CAST(cost AS DOUBLE) / calls, 6) AS dollar_per_call, "
    "round(CASE WHEN rd + inp = 0 THEN 0.0 ELSE CAST(rd AS DOUBLE) / CAST(rd + inp AS DOUBLE) END * 100.0, 6) AS cache_hit_pct, "
    "CAST(floor(inp / calls) AS BIGINT) AS avg_input_tokens FROM (SELECT primary_tag AS value, count(*) AS calls, "
    "sum(cost_usd) AS cost, sum(tokens_cache_read) AS rd, sum(tokens_input) AS inp FROM spend GROUP BY 1) "
    "ORDER BY cost DESC, value LIMIT 20",
)
def diagnostic_panel_report(spark, sf_dir):
    return plain(at.diagnostics(spend(spark, sf_dir), "primary_tag", report_style=True))


@query(
    "diagnostic_panel_dashboard",
    f"{SPEND_CTE} SELECT value, calls, dollar_per_call, cache_hit_pct, avg_input_tokens FROM (SELECT value, {METRICS} "
    f"FROM (SELECT primary_tag AS value, {SUMS} FROM spend GROUP BY 1)) ORDER BY cost_usd DESC, value LIMIT 20",
)
def diagnostic_panel_dashboard(spark, sf_dir):
    return plain(at.diagnostics(spend(spark, sf_dir), "primary_tag"))


@query(
    "matrix_long",
    f"{SPEND_CTE} SELECT domain, activity, count(*) AS calls, round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd "
    "FROM spend GROUP BY ALL",
)
def matrix_long(spark, sf_dir):
    return plain(at.domain_activity(spend(spark, sf_dir)))


MATRIX_COLUMNS = (*ACTIVITY_VALUES, at.FAILED, at.NO_CLASSIFICATION)  # what occurs in the tables; the job finds it itself


@query(
    "matrix_pivot",
    f"{SPEND_CTE} SELECT domain, "
    + ", ".join(
        f"round(CAST(coalesce(sum(cost_usd) FILTER (WHERE activity = '{a}'), 0) AS DOUBLE), 6) AS \"{a}\"" for a in MATRIX_COLUMNS
    )
    + " FROM spend GROUP BY domain",
)
def matrix_pivot(spark, sf_dir):
    return plain(at.domain_activity_pivot(spend(spark, sf_dir)))


@query(
    "matrix_cube",
    f"{SPEND_CTE} SELECT CASE WHEN grouping(domain) = 1 THEN 'TOTAL' ELSE domain END AS domain, "
    "CASE WHEN grouping(activity) = 1 THEN 'TOTAL' ELSE activity END AS activity, count(*) AS calls, "
    "round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd FROM spend GROUP BY CUBE (spend.domain, spend.activity)",
)
def matrix_cube(spark, sf_dir):
    return plain(at.domain_activity_totals(spend(spark, sf_dir)))


@query(
    "upper_median",
    f"{SPEND_CTE} SELECT count(*) AS calls, round(CAST(sum(cost_usd) AS DOUBLE), 6) AS total_cost, "
    "round(CAST((SELECT cost_usd FROM spend ORDER BY cost_usd LIMIT 1 OFFSET (SELECT count(*) // 2 FROM spend)) AS DOUBLE), 6) AS upper_median, "
    "round(CAST(sum(cost_usd) FILTER (WHERE len(tags) = 0) AS DOUBLE), 6) AS untagged_cost, "
    "count(*) FILTER (WHERE len(tags) = 0) AS untagged_calls FROM spend",
)
def upper_median(spark, sf_dir):
    return plain(at.report_summary(spend(spark, sf_dir)))


@query(
    "kpi_summary",
    f"{SPEND_CTE}, s AS (SELECT CAST(sum(cost_usd) AS DOUBLE) AS total, count(*) AS n, median(CAST(cost_usd AS DOUBLE)) AS med, "
    "CAST(sum(cost_usd) FILTER (WHERE primary_tag = '_untagged') AS DOUBLE) AS u, "
    "CAST(sum(cost_usd) FILTER (WHERE primary_tag = '_unknown') AS DOUBLE) AS k, "
    "count(*) FILTER (WHERE classifier_failed) AS f FROM spend) "
    "SELECT round(total, 6) AS total_cost, n AS total_calls, round(med, 6) AS median_cost, round(u / total * 100.0, 6) AS untagged_pct, "
    "round(u, 6) AS untagged_cost, round(k / total * 100.0, 6) AS unknown_pct, round(k, 6) AS unknown_cost, f AS classifier_failures FROM s",
)
def kpi_summary(spark, sf_dir):
    return plain(at.kpis(spend(spark, sf_dir)))


SESSIONS = f"""{SPEND_CTE}, known AS (SELECT * FROM spend WHERE session_id IS NOT NULL),
tag AS (SELECT session_id, primary_tag AS top_tag FROM known GROUP BY session_id, primary_tag
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, primary_tag) = 1),
proj AS (SELECT session_id, primary_project AS top_project FROM known GROUP BY session_id, primary_project
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, primary_project) = 1),
sessions AS (SELECT session_id, count(*) AS calls, CAST(sum(cost_usd) AS DOUBLE) AS cost, min(ts) AS a, max(ts) AS b
  FROM known GROUP BY 1)
"""


@query(
    "session_rollup",
    f"{SESSIONS} SELECT session_id, calls, round(cost, 6) AS cost_usd, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_call, "
    "strftime(b, '%Y-%m-%d %H:%M:%S') AS last_call, top_tag, top_project, round(cost / calls, 9) AS dollar_per_call, "
    "round(date_diff('second', a, b) / 60.0, 1) AS duration_min FROM sessions JOIN tag USING (session_id) JOIN proj USING (session_id)",
)
def session_rollup(spark, sf_dir):
    sessions = at.session_durations(spend(spark, sf_dir))
    for column in ("first_call", "last_call"):
        sessions = sessions.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))
    return plain(sessions, 9)


@query(
    "session_kpis",
    f"{SESSIONS} SELECT count(*) AS sessions, round(median(cost), 6) AS median_per_session FROM sessions",
)
def session_kpis(spark, sf_dir):
    return plain(at.session_kpis(spend(spark, sf_dir)))


@query(
    "session_drilldown",
    f"{SPEND_CTE} SELECT session_id, call_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS local_time, model, "
    "round(CAST(cost_usd AS DOUBLE), 6) AS cost_usd, primary_tag, primary_project, activity FROM spend WHERE session_id = 's42'",
)
def session_drilldown(spark, sf_dir):
    calls = at.session_calls(spend(spark, sf_dir), "s42")
    return plain(
        calls.select(
            "session_id", "call_id", F.date_format("timestamp_local", "yyyy-MM-dd HH:mm:ss").alias("local_time"), "model",
            "cost_usd", "primary_tag", "primary_project", "activity",
        )
    )


DAILY = (
    f"{SPEND_CTE}, daily AS (SELECT local_date AS date, round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd, count(*) AS calls, "
    "round(avg(CASE WHEN primary_tag = '_untagged' THEN 1.0::DOUBLE ELSE 0.0 END) * 100.0, 6) AS untagged_pct, "
    "round(avg(CASE WHEN primary_tag = '_unknown' THEN 1.0::DOUBLE ELSE 0.0 END) * 100.0, 6) AS failure_pct FROM spend GROUP BY 1) "
)


@query("daily_totals", f"{DAILY} SELECT * FROM daily")
def daily_totals(spark, sf_dir):
    return plain(at.daily_totals(spend(spark, sf_dir)))


@query(
    "daily_trend",
    f"{DAILY} SELECT date, 'Untagged %' AS metric, untagged_pct AS pct FROM daily UNION ALL "
    "SELECT date, 'Failure %', failure_pct FROM daily",
)
def daily_trend(spark, sf_dir):
    return plain(at.daily_trend(spend(spark, sf_dir)))


FIRST, LAST = date(1998, 3, 1), date(1998, 3, 31)


@query(
    "date_range",
    f"{SPEND_CTE}, moved AS (SELECT *, CAST(ts - INTERVAL 5 HOUR AS DATE) AS d FROM spend) SELECT d AS local_date, count(*) AS calls, "
    f"round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd FROM moved WHERE d BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY 1",
)
def date_range(spark, sf_dir):
    zone = "-05:00"
    kept = at.by_date(spend_rows(spark, sf_dir), FIRST, LAST, zone)
    wide = at.flatten_spend(kept, zone)
    return plain(wide.groupBy("local_date").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd")))


@query(
    "period_delta",
    f"""{SPEND_CTE}, p AS (SELECT
  CAST(sum(cost_usd) FILTER (WHERE local_date >= DATE '{FIRST}') AS DOUBLE) AS cost,
  CAST(sum(cost_usd) FILTER (WHERE local_date < DATE '{FIRST}') AS DOUBLE) AS prev_cost,
  count(*) FILTER (WHERE local_date >= DATE '{FIRST}') AS calls, count(*) FILTER (WHERE local_date < DATE '{FIRST}') AS prev_calls,
  CAST(sum(cost_usd) FILTER (WHERE local_date >= DATE '{FIRST}' AND primary_tag = '_untagged') AS DOUBLE) AS u,
  CAST(sum(cost_usd) FILTER (WHERE local_date < DATE '{FIRST}' AND primary_tag = '_untagged') AS DOUBLE) AS pu,
  count(*) FILTER (WHERE local_date >= DATE '{FIRST}' AND classifier_failed) AS failures,
  count(*) FILTER (WHERE local_date < DATE '{FIRST}' AND classifier_failed) AS prev_failures
  FROM spend WHERE local_date BETWEEN DATE '{FIRST}' - 31 AND DATE '{LAST}')
SELECT round(cost, 6) AS cost, round(prev_cost, 6) AS prev_cost, calls, prev_calls, failures, prev_failures,
  round((cost - prev_cost) / prev_cost * 100.0, 6) AS cost_delta_pct,
  round(CAST(calls - prev_calls AS DOUBLE) / prev_calls * 100.0, 6) AS calls_delta_pct,
  round((coalesce(u, 0) / cost - coalesce(pu, 0) / prev_cost) * 100.0, 6) AS untagged_delta_pp,
  failures - prev_failures AS failures_delta FROM p""",
)
def period_delta(spark, sf_dir):
    return plain(at.period_delta(spend(spark, sf_dir), FIRST, LAST))


@query(
    "date_presets",
    f"{SPEND_CTE}, m AS (SELECT max(local_date) AS d FROM spend) SELECT 'Last 7 days' AS preset, d - 6 AS first, d AS last FROM m "
    "UNION ALL SELECT 'Today', DATE '2001-06-14', DATE '2001-06-14' UNION ALL SELECT 'This week', DATE '2001-06-11', DATE '2001-06-14' "
    "UNION ALL SELECT 'This month', DATE '2001-06-01', DATE '2001-06-14' UNION ALL SELECT 'Last 30 days', d - 29, d FROM m "
    "UNION ALL SELECT 'All time', NULL, NULL",
)
def date_presets(spark, sf_dir):
    return at.preset_bounds(spend(spark, sf_dir), date(2001, 6, 14))


@query(
    "call_search",
    f"{SPEND_CTE} SELECT call_id, agent, model, round(CAST(cost_usd AS DOUBLE), 6) AS cost_usd FROM spend WHERE agent IN ('agent-A', 'agent-R') "
    "AND list_has_any(tags, ['sports', 'music']) AND list_has_any(projects, ['proj-3', 'proj-7', 'proj-11']) "
    "AND contains(lower(prompt_prefix), 'part 1')",
)
def call_search(spark, sf_dir):
    found = at.search_calls(
        spend(spark, sf_dir), agents=["agent-A", "agent-R"], tags=["sports", "music"],
        projects=["proj-3", "proj-7", "proj-11"], prompt=" PART 1",
    )
    return plain(found.select("call_id", "agent", "model", "cost_usd"))


@query(
    "p95_calls",
    f"{SPEND_CTE}, q AS (SELECT quantile_cont(CAST(cost_usd AS DOUBLE), 0.95) AS p FROM spend) SELECT flag, agent, count(*) AS calls, "
    "round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd FROM (SELECT *, CASE WHEN classifier_error IS NOT NULL THEN 'error' "
    "WHEN CAST(cost_usd AS DOUBLE) >= (SELECT p FROM q) THEN 'p95' ELSE '' END AS flag FROM spend) GROUP BY ALL",
)
def p95_calls(spark, sf_dir):
    flagged = at.flag_costly(spend(spark, sf_dir))
    return plain(flagged.groupBy("flag", "agent").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd")))


@query(
    "filter_options",
    f"{SPEND_CTE} SELECT DISTINCT kind, value FROM (SELECT 'agent' AS kind, agent AS value FROM spend UNION ALL SELECT 'model', model FROM spend "
    "UNION ALL SELECT 'tag', unnest(tags) FROM spend UNION ALL SELECT 'project', unnest(projects) FROM spend) WHERE value <> 'unknown' OR kind <> 'project'",
)
def filter_options(spark, sf_dir):
    return at.filter_options(spend(spark, sf_dir))


@query(
    "value_drilldown",
    f"{SPEND_CTE} SELECT call_id, primary_tag, round(CAST(cost_usd AS DOUBLE), 6) AS cost_usd FROM spend "
    "WHERE list_contains(tags, 'music') OR primary_tag = '_untagged'",
)
def value_drilldown(spark, sf_dir):
    frame = spend(spark, sf_dir)
    rows = at.calls_with_value(frame, "tags", "music").unionByName(at.calls_with_value(frame, "tags", "_untagged"))
    return plain(rows.select("call_id", "primary_tag", "cost_usd"))


@query(
    "combined_values",
    f"{SPEND_CTE}, p AS (SELECT primary_tag AS value, round(CAST(sum(cost_usd) AS DOUBLE), 6) AS primary_cost FROM spend GROUP BY 1), "
    "a AS (SELECT value, round(CAST(sum(cost_usd) AS DOUBLE), 6) AS any_cost FROM (SELECT unnest(tags) AS value, cost_usd FROM spend) GROUP BY 1) "
    "SELECT coalesce(p.value, a.value) AS value, primary_cost, any_cost FROM p FULL JOIN a ON p.value = a.value",
)
def combined_values(spark, sf_dir):
    return plain(at.combined_values(spend(spark, sf_dir), "tags"))


@query(
    "spend_by_pipeline_version",
    f"{SPEND_CTE} SELECT coalesce(pipeline_version, '(unset)') AS pipeline_version, count(*) AS calls, "
    "round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd FROM spend GROUP BY 1",
)
def spend_by_pipeline_version(spark, sf_dir):
    return plain(at.by_pipeline_version(spend(spark, sf_dir)))


@query(
    "top_failures",
    f"{SPEND_CTE} SELECT call_id, round(CAST(cost_usd AS DOUBLE), 6) AS cost_usd, tokens_input, classifier_error FROM spend "
    "WHERE classifier_failed ORDER BY spend.cost_usd DESC, call_id LIMIT 20",
)
def top_failures(spark, sf_dir):
    return plain(at.top_failures(spend(spark, sf_dir)).select("call_id", "cost_usd", "tokens_input", "classifier_error"))


@query(
    "lens_invariants",
    f"{PIVOT}, t AS (SELECT facet, sum(cost) FILTER (WHERE lens = 'primary') AS primary_cost, "
    "sum(cost) FILTER (WHERE lens = 'primary' AND left(value, 1) <> '_') AS valued, sum(cost) FILTER (WHERE lens = 'any') AS any_cost "
    "FROM buckets GROUP BY facet) SELECT facet, round(CAST(primary_cost AS DOUBLE), 6) AS primary_cost, round(CAST(valued AS DOUBLE), 6) AS valued, "
    "round(CAST(any_cost AS DOUBLE), 6) AS any_cost FROM t WHERE primary_cost <> (SELECT sum(cost_usd) FROM spend) OR any_cost < valued",
)
def lens_invariants(spark, sf_dir):
    return plain(at.lens_invariants(spend_rows(spark, sf_dir)))


@query(
    "lens_sums",
    f"{PIVOT}, t AS (SELECT facet, sum(cost) FILTER (WHERE lens = 'primary') AS primary_cost, "
    "sum(cost) FILTER (WHERE lens = 'primary' AND left(value, 1) <> '_') AS valued, sum(cost) FILTER (WHERE lens = 'any') AS any_cost "
    "FROM buckets GROUP BY facet) SELECT facet, round(CAST(primary_cost AS DOUBLE), 6) AS primary_cost, round(CAST(valued AS DOUBLE), 6) AS valued, "
    "round(CAST(any_cost AS DOUBLE), 6) AS any_cost, primary_cost = (SELECT sum(cost_usd) FROM spend) AND any_cost >= valued AS holds FROM t",
)
def lens_sums(spark, sf_dir):
    return plain(at.lens_sums(spend_rows(spark, sf_dir)))


@query(
    "display_shares",
    f"{SPEND_CTE}, b AS (SELECT agent, model, sum(cost_usd) AS cost, max(ts) AS seen FROM spend GROUP BY 1, 2), t AS (SELECT sum(cost) AS total, max(seen) AS latest FROM b), "
    "x AS (SELECT *, CAST(cost AS DOUBLE) AS c, CAST(total AS DOUBLE) AS whole, epoch(latest) - epoch(seen) + 7 AS s FROM b, t) "
    "SELECT agent, model, printf('%.1f%%', c / whole * 100.0) AS share, CASE WHEN agent = 'agent-A' THEN '—' ELSE printf('%.1f%%', c / whole * 100.0) END AS known_share, "
    "'—' AS none, CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN concat(CAST(floor(s) AS BIGINT), 's ago') WHEN s < 3600 THEN concat(CAST(floor(s / 60) AS BIGINT), 'm ago') "
    "WHEN s < 86400 THEN printf('%.1fh ago', s / 3600.0) ELSE printf('%.1fd ago', s / 86400.0) END AS age FROM x",
)
def display_shares(spark, sf_dir):
    """Shares, missing shares and ages of agents and models."""
    buckets = spend(spark, sf_dir).groupBy("agent", "model").agg(F.sum("cost_usd").cast("double").alias("cost"), F.max("timestamp").alias("seen"))
    totals = buckets.agg(F.sum("cost").alias("whole"), F.max("seen").alias("latest"))
    both = buckets.crossJoin(totals)  # one row
    seconds = F.unix_micros("latest") / 1e6 - F.unix_micros("seen") / 1e6 + 7
    known = F.when(F.col("agent") != "agent-A", F.col("cost") / F.col("whole") * 100.0)
    return both.select(
        "agent", "model", display.share_of(F.col("cost"), F.col("whole")).alias("share"), display.percent(known).alias("known_share"),
        display.share_of(F.col("cost"), F.lit(0.0)).alias("none"), display.age(seconds).alias("age"),
    )


@query(
    "display_labels",
    f"""{SPEND_CTE}, b AS (SELECT agent, sum(cost_usd) * v.f AS cost, sum(tokens_cache_read) AS rd, sum(total_input_tokens) AS tot
  FROM spend, (VALUES (1.0), (0.001), (0.0000001), (0.000000001)) v(f) GROUP BY agent, v.f)
SELECT agent, CASE WHEN cost >= 100 THEN format('${{:,}}', CAST(round_even(CAST(cost AS DOUBLE), 0) AS BIGINT))
  WHEN cost >= 1 THEN printf('$%.2f', CAST(cost AS DOUBLE)) WHEN cost >= 0.001 THEN printf('$%.4f', CAST(cost AS DOUBLE))
  ELSE printf('$%.6f', CAST(cost AS DOUBLE)) END AS money, printf('%.0f%%', CAST(rd AS DOUBLE) / CAST(tot AS DOUBLE) * 100.0) AS cache FROM b""",
)
def display_labels(spark, sf_dir):
    totals = spend(spark, sf_dir).groupBy("agent").agg(
        F.sum("cost_usd").alias("cost"), F.sum("tokens_cache_read").alias("rd"), F.sum("total_input_tokens").alias("tot")
    )
    factors = F.explode(F.expr("array(1.0BD, 0.001BD, 0.0000001BD, 0.000000001BD)")).alias("f")
    return totals.select("*", factors).select(
        "agent",
        display.money((F.col("cost") * F.col("f")).cast("double")).alias("money"),
        display.cache_share(F.col("rd"), F.col("tot")).alias("cache"),
    )
