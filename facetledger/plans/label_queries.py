"""Classifiers and resolution over events and conversations read as calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetledger.operators import classify as cl
from facetledger.operators import resolve as rs
from facetledger.plans.cost_queries import sql_list
from facetledger.plans.registry import plain, query
from facetledger.schemas import FACETS, SCALAR_FACETS, override_facet
from facetledger.sources.tables import EVENT_BRANCHES, event_calls, load
from facetledger.vocab import BRANCH_ACTIVITY, DOMAIN_KEYWORDS, TAG_KEYWORDS

BRANCH_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_BRANCHES.items()) + " END"

CALLS_CTE = f"""
WITH base AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
calls AS (
  SELECT concat('e', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS call_id, event_id, user_id AS uid, k, event_type, value, ts,
    CASE WHEN user_id % 40 = 7 THEN NULL ELSE concat('u', user_id) END AS session_id,
    CASE k % 5 WHEN 0 THEN 'yes' WHEN 1 THEN concat('refactor the ', event_type, ' function and fix the bug in the code')
      WHEN 2 THEN concat('budget forecast for ', event_type, ' revenue and one invoice, ticket PAY-', 10 + k)
      WHEN 3 THEN concat('find a flight, a hotel and a hotel recipe about ', event_type, ' please now')
      ELSE concat('note ', event_type, ' ', k) END AS text,
    CASE WHEN user_id % 3 = 0 THEN '/home/u/repos/shop/' WHEN user_id % 3 = 1 THEN '/home/u/taxes/y2024'
      WHEN event_id % 97 = 0 THEN '/tmp/other' ELSE '/tmp/plain' END AS workdir,
    CASE WHEN event_type <> 'view' THEN {BRANCH_SQL} END AS branch,
    CASE WHEN event_type <> 'view' AND k % 4 = 0 THEN concat('repo-', user_id % 7) END AS repo,
    CASE WHEN event_id % 50 = 0 THEN concat('req-', k % 4) END AS request_project,
    CASE WHEN k % 9 = 0 THEN concat('team-', user_id % 5) END AS team
  FROM base
)
"""


def calls(spark, sf_dir):
    return event_calls(spark, sf_dir).drop("cost_usd")


def verdicts(spark, sf_dir, **classifiers):
    """Long form of the candidates of chosen classifiers."""
    rows = cl.with_candidates(calls(spark, sf_dir), classifiers).select("call_id", F.inline("candidates"))
    return rows.select("call_id", "value", "confidence", "source")


@query(
    "context_rules",
    f"{CALLS_CTE} SELECT call_id, CASE WHEN workdir LIKE '%/taxes/%' THEN 'personal' WHEN workdir LIKE '%/repos/%' THEN 'business' ELSE 'unknown' END AS value, "
    "CASE WHEN workdir LIKE '/tmp%' THEN 0.5::DOUBLE ELSE 0.85 END AS confidence, CASE WHEN workdir LIKE '%/taxes/%' THEN 'workdir-personal-fragment' "
    "WHEN workdir LIKE '%/repos/%' THEN 'workdir-business-fragment' ELSE 'default-unknown' END AS source FROM calls",
)
def context_rules(spark, sf_dir):
    return verdicts(spark, sf_dir, context=cl.context_rules)


def count_sql(words, text: str) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


DOMAIN_SQL = (
    f"{CALLS_CTE}, s AS (SELECT call_id, unnest(["
    + ", ".join(f"{{'n': {count_sql(w, 'lower(text)')}, 'ord': {i}, 'domain': '{d}'}}" for i, (d, w) in enumerate(DOMAIN_KEYWORDS.items()))
    + "]) AS s FROM calls), r AS (SELECT call_id, s.domain AS domain, s.n AS n, row_number() OVER (PARTITION BY call_id ORDER BY s.n DESC, s.ord) AS rk FROM s) "
)


@query(
    "domain_keywords",
    f"{DOMAIN_SQL}, o AS (SELECT call_id, string_agg(concat(domain, '=', CAST(round(least(0.6, 0.3 + 0.1 * n), 1) AS VARCHAR)), ',' ORDER BY rk) AS alternatives "
    "FROM r WHERE rk > 1 AND n > 0 GROUP BY 1) SELECT call_id, CASE WHEN n = 0 THEN 'unknown' ELSE domain END AS value, "
    "CASE WHEN n = 0 THEN 0.4::DOUBLE WHEN n = 1 THEN 0.6 ELSE 0.8 END AS confidence, CASE WHEN n = 0 THEN 'default-unknown' ELSE concat('keywords-', n, '-hits') END AS source, "
    "coalesce(alternatives, '') AS alternatives FROM r LEFT JOIN o USING (call_id) WHERE rk = 1",
)
def domain_keywords(spark, sf_dir):
    rows = cl.with_candidates(calls(spark, sf_dir), {"domain": cl.domain_keywords}).select("call_id", F.inline("candidates"))
    listed = F.transform("alternatives", lambda a: F.concat(a["value"], F.lit("="), F.round(a["confidence"], 1).cast("string")))
    return rows.select("call_id", "value", "confidence", "source", F.array_join(listed, ",").alias("alternatives"))


ACTIVITY_SQL = "CASE " + " ".join(f"WHEN starts_with(branch, '{p}') THEN '{a}'" for p, a in BRANCH_ACTIVITY.items()) + " WHEN k % 6 = 0 THEN 'verifying' ELSE 'unknown' END"


@query(
    "activity_rules",
    f"{CALLS_CTE} SELECT call_id, {ACTIVITY_SQL} AS value, CASE WHEN branch IS NOT NULL THEN 0.9::DOUBLE WHEN k % 6 = 0 THEN 0.8 ELSE 0.5 END AS confidence, "
    "CASE WHEN branch IS NOT NULL THEN concat('git-branch-prefix-', split_part(branch, '/', 1)) WHEN k % 6 = 0 THEN 'test-file-path' ELSE 'default-unknown' END AS source FROM calls",
)
def activity_rules(spark, sf_dir):
    return verdicts(spark, sf_dir, activity=cl.activity_rules)


PROJECT_SQL = f"""{CALLS_CTE}, p AS (
  SELECT call_id, request_project AS value, 1.0::DOUBLE AS confidence, 'request-tag-project' AS source, 0 AS ord FROM calls WHERE request_project IS NOT NULL
  UNION ALL SELECT call_id, concat('tagged-', uid % 3), 1.0, 'in-prompt-hashtag', 1 FROM calls WHERE k % 25 = 0
  UNION ALL SELECT call_id, concat('cmd-', uid % 2), 1.0, 'in-prompt-command-new-project', 2 FROM calls WHERE k % 33 = 0
  UNION ALL SELECT call_id, repo, 0.95, 'git-repo-name', 3 FROM calls WHERE repo IS NOT NULL
  UNION ALL SELECT call_id, regexp_extract(branch, '[A-Z]+-[0-9]{{2,5}}'), 0.85, 'git-branch-ticket', 4 FROM calls WHERE regexp_matches(branch, '[A-Z]+-[0-9]{{2,5}}')
  UNION ALL SELECT call_id, CASE uid % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'y2024' ELSE split_part(workdir, '/', 3) END, 0.8, 'workdir-basename', 5 FROM calls
  UNION ALL SELECT call_id, regexp_extract(text, 'PAY-[0-9]+'), 0.9, 'prompt-ticket-ref', 6 FROM calls WHERE k % 5 = 2
  UNION ALL SELECT call_id, concat('registered-', uid % 5), 1.0, 'team-registry', 7 FROM calls WHERE team IS NOT NULL AND uid % 5 < 3)
"""


def team_calls(spark, sf_dir):
    registry = load(spark, sf_dir, "region").selectExpr(
        "concat('team-', r_regionkey) as team_alias", "concat('registered-', r_regionkey) as project"
    ).filter("team_alias in ('team-0', 'team-1', 'team-2')")
    return cl.with_team_projects(calls(spark, sf_dir), registry)


def project_set():
    return {
        "explicit": cl.project_explicit, "repo": cl.project_git_repo, "branch": cl.project_git_branch,
        "workdir": cl.project_workdir, "ticket": cl.project_ticket_ref,
        "team": lambda: cl.project_team_registry(F.col("team_project")),
    }


@query("project_signals", f"{PROJECT_SQL} SELECT call_id, value, confidence, source FROM p")
def project_signals(spark, sf_dir):
    rows = cl.with_candidates(team_calls(spark, sf_dir), project_set()).select("call_id", F.inline("candidates"))
    return rows.select("call_id", "value", "confidence", "source")


def tag_sql(words) -> str:
    escaped = [w.replace("/", "\\/") for w in words]
    return "len(regexp_extract_all(lower(text), '\\b(?:" + "|".join(escaped) + ")\\b'))"


TAGS_SQL = (
    f"{CALLS_CTE}, t AS (SELECT call_id, unnest([" + ", ".join(f"{{'tag': '{t}', 'n': {tag_sql(w)}, 'ord': {i}}}" for i, (t, w) in enumerate(TAG_KEYWORDS.items()))
    + "]) AS t FROM calls), tags AS (SELECT call_id, t.tag AS value, CASE t.n WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.65 ELSE 0.8 END AS confidence, "
    "concat('keyword-', t.n, '-hits') AS source, t.ord AS ord FROM t WHERE t.n > 0)"
)


@query("keyword_tagger", f"{TAGS_SQL} SELECT call_id, value, confidence, source FROM tags")
def keyword_tagger(spark, sf_dir):
    return verdicts(spark, sf_dir, tags=cl.keyword_tagger)


LANGUAGE_WORDS = {"english": ("the", "and", "that"), "french": ("que", "le", "la", "été"), "german": ("die", "zu", "über")}


@query(
    "keyword_tagger_documents",
    "WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+') AS words FROM documents), "
    "t AS (SELECT doc_id, unnest([" + ", ".join(
        f"{{'tag': '{t}', 'n': len(list_filter(words, lambda x: x IN ({','.join(repr(v) for v in w)})))}}" for t, w in LANGUAGE_WORDS.items()
    ) + "]) AS t FROM w) SELECT concat('d', doc_id) AS call_id, t.tag AS value, CASE t.n WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.65 ELSE 0.8 END AS confidence, "
    "concat('keyword-', t.n, '-hits') AS source FROM t WHERE t.n > 0",
)
def keyword_tagger_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("call_id"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"),
    )
    rows = cl.with_candidates(docs, {"tags": lambda: cl.keyword_tagger(LANGUAGE_WORDS)}).select("call_id", F.inline("candidates"))
    return rows.select("call_id", "value", "confidence", "source")


@query(
    "resolve_scalar",
    f"{DOMAIN_SQL} SELECT call_id, 'domain' AS facet, domain AS value, CASE WHEN n = 1 THEN 0.6::DOUBLE ELSE 0.8 END AS confidence FROM r WHERE rk = 1 AND n > 0 "
    "UNION ALL SELECT call_id, 'context', CASE WHEN workdir LIKE '%/taxes/%' THEN 'personal' WHEN workdir LIKE '%/repos/%' THEN 'business' ELSE 'unknown' END, CASE WHEN workdir LIKE '/tmp%' THEN 0.5 ELSE 0.85 END FROM calls "
    f"UNION ALL SELECT call_id, 'activity', {ACTIVITY_SQL}, CASE WHEN branch IS NOT NULL THEN 0.9 WHEN k % 6 = 0 THEN 0.8 ELSE 0.5 END FROM calls",
)
def resolve_scalar(spark, sf_dir):
    classified = rs.classify(calls(spark, sf_dir))
    found = F.array(*[rs.best(F.col("classifications"), f) for f in SCALAR_FACETS])
    return classified.select("call_id", F.inline(F.filter(found, lambda v: v.isNotNull()))).select("call_id", "facet", "value", "confidence")


@query(
    "resolve_scalar_alternatives",
    f"{CALLS_CTE}, c AS (SELECT call_id, {ACTIVITY_SQL} AS a, CASE WHEN branch IS NOT NULL THEN 0.9::DOUBLE WHEN k % 6 = 0 THEN 0.8 ELSE 0.5 END AS ac, "
    "CASE WHEN k % 2 = 0 THEN 0.85::DOUBLE ELSE 0.3 END AS bc FROM calls) SELECT call_id, CASE WHEN bc > ac THEN 'planning' ELSE a END AS value, "
    "greatest(ac, CASE WHEN bc >= 0.5 THEN bc ELSE 0 END) AS confidence, CASE WHEN bc < 0.5 THEN '' WHEN bc > ac THEN a ELSE 'planning' END AS alternative FROM c",
)
def resolve_scalar_alternatives(spark, sf_dir):
    second = lambda: F.array(
        cl.verdict("activity", F.lit("planning"), F.when(F.col("_k") % 2 == 0, 0.85).otherwise(0.3), "second", "second")
    )
    k = load(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("call_id"), F.get_json_object("props", "$.k").cast("int").alias("_k")
    )
    rows = calls(spark, sf_dir).join(k, "call_id")
    classified = rs.classify(rows, {"activity": cl.activity_rules, "second": second})
    best = rs.best(F.col("classifications"), "activity")
    return classified.select(
        "call_id", best["value"].alias("value"), best["confidence"].alias("confidence"),
        F.array_join(F.transform(best["alternatives"], lambda a: a["value"]), ",").alias("alternative"),
    )


@query(
    "resolve_array",
    f"{PROJECT_SQL}, d AS (SELECT call_id, value, max(confidence) AS confidence, min(ord) AS ord FROM p GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY confidence DESC, ord) AS rk FROM d) "
    "SELECT call_id, string_agg(concat(value, ':', CAST(round(confidence, 2) AS VARCHAR)), ',' ORDER BY rk) AS projects FROM r WHERE rk <= 3 GROUP BY 1",
)
def resolve_array(spark, sf_dir):
    classified = rs.classify(team_calls(spark, sf_dir), project_set())
    listed = F.transform("classifications", lambda c: F.concat(c["value"], F.lit(":"), F.round(c["confidence"], 2).cast("string")))
    return classified.select("call_id", F.array_join(listed, ",").alias("projects")).filter("projects <> ''")


@query(
    "facet_floor_override",
    f"{TAGS_SQL} SELECT call_id, value, confidence FROM tags WHERE confidence >= 0.65",
)
def facet_floor_override(spark, sf_dir):
    classified = rs.classify(calls(spark, sf_dir), {"tags": cl.keyword_tagger}, override_facet("tags", min_confidence=0.65))
    return rs.long_form(classified).select("call_id", "value", "confidence")


@query(
    "unknown_facets_dropped",
    f"{CALLS_CTE} SELECT call_id, 'context' AS facet FROM calls",
)
def unknown_facets_dropped(spark, sf_dir):
    stray = lambda: F.array(cl.verdict("mood", F.lit("good"), 1.0, "stray", "stray"))
    return rs.long_form(rs.classify(calls(spark, sf_dir), {"context": cl.context_rules, "stray": stray})).select("call_id", "facet")


@query(
    "facet_defaults",
    f"{DOMAIN_SQL} SELECT call_id, CASE WHEN n = 0 THEN 'unknown' ELSE domain END AS domain, 'unknown' AS project, 0 AS tags FROM r WHERE rk = 1",
)
def facet_defaults(spark, sf_dir):
    classified = rs.classify(calls(spark, sf_dir), {"domain": cl.domain_keywords})
    filled = rs.with_defaults(F.col("classifications"), FACETS)
    return classified.select("call_id", filled["domain"].alias("domain"), F.array_join(filled["project"], ",").alias("project"), F.size(filled["tags"]).alias("tags"))


@query(
    "predictions_reduced",
    f"{TAGS_SQL} SELECT calls.call_id, {ACTIVITY_SQL} AS activity, 'unknown' AS project, coalesce(string_agg(tags.value, ',' ORDER BY tags.confidence DESC, tags.ord), '') AS tags "
    "FROM calls LEFT JOIN tags ON tags.call_id = calls.call_id GROUP BY ALL",
)
def predictions_reduced(spark, sf_dir):
    classified = rs.classify(calls(spark, sf_dir), {"activity": cl.activity_rules, "tags": cl.keyword_tagger})
    reduced = rs.prediction(F.col("classifications"))
    return classified.select("call_id", reduced["activity"].alias("activity"), F.array_join(reduced["project"], ",").alias("project"), F.array_join(reduced["tags"], ",").alias("tags"))


def coverage_sql(own_verdicts: str, kept: str) -> str:
    return f"{CALLS_CTE}{own_verdicts}cand AS (SELECT * FROM own), {kept} SELECT facet, count(*) AS verdicts, round(avg(confidence), 6) AS mean FROM final GROUP BY 1"


def classify_coverage(spark, sf_dir):
    """Registered with the session queries, whose SQL has the verdicts of all facets."""
    long = rs.long_form(rs.classify(calls(spark, sf_dir)))
    return plain(long.groupBy("facet").agg(F.count(F.lit(1)).alias("verdicts"), F.avg("confidence").alias("mean")))
